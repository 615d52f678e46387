"""How much work a store of generated texts takes."""

from tablewright.operators import answers


def test_jobs_do_not_grow_with_the_rounds(spark, tmp_path):
    rows = [(i, f"What is {i}?", "#### 1") for i in range(60)]
    questions = spark.createDataFrame(rows, "example_id long, question string, answer string")
    jobs = {}
    for commit_rows in (60, 3):
        group = f"stored-{commit_rows}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            got = answers.attach_stored_generator(
                questions, "example_id", lambda prompts: [p.upper() for p in prompts], "m", str(tmp_path / group), commit_rows=commit_rows
            ).collect()
        finally:
            spark.sparkContext._jsc.clearJobGroup()
        assert len(got) == 60 and all(r.question.upper() in r.prediction for r in got)
        jobs[commit_rows] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    assert jobs[3] <= jobs[60] + 2
