"""The registered queries, their SQL, and the pipeline against a plain composition of its stages."""

import hashlib

import corpus_pipeline
import numpy as np
import pytest
from compare import connect, duck_table, spark_table
from test_exact import BLANKS
from test_simhash import plain_print, roots

from tablewright.llm import decontamination, pieces, quality_crf
from tablewright.llm.common import table
from tablewright.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_its_sql(spark, folder, name):
    assert spark_table(QUERIES[name], spark, folder) == duck_table(ORACLES[name], connect(folder))


@pytest.mark.parametrize("n", range(1, 14))
def test_every_operator_has_a_query(n):
    assert len([q for q in QUERIES if q.startswith(f"op{n}_")]) == 1


@pytest.mark.parametrize("name", ["op1_quality", "op2_secrets", "op3_personal_data", "op4_simhash", "op6_shard_packing", "op7_language", "op8_pieces", "op11_bpe", "op13_periodic_runs"])
def test_one_row_per_document(spark, folder, name):
    rows = QUERIES[name](spark, folder).select("doc_id").collect()
    documents = table(spark, folder, "documents").select("doc_id").collect()
    assert sorted(r[0] for r in rows) == sorted(r[0] for r in documents)


@pytest.mark.parametrize("name", ["op2_secrets", "op3_personal_data"])
def test_native_operators_run_no_python(spark, folder, name):
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "InArrow", "CartesianProduct", "NestedLoop"))


def plain_pipeline(spark, folder):
    docs, labels, items = (table(spark, folder, t) for t in ("documents", "labels", "benchmark"))
    field = quality_crf.fit(docs, labels)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = [(i, t) for i, t in rows if field.scores([t])[0] >= 0.3]
    first = {}
    for i, t in sorted(rows, key=lambda r: (-len(r[1]), r[0])):
        first.setdefault(BLANKS.sub("", t), (i, t))
    rows = sorted(first.values())
    prints = [plain_print(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    root = roots(len(rows), links)
    rows = [r for k, r in enumerate(rows) if root[k] == k]
    numbers = {}
    number = lambda text: np.array([numbers.setdefault(w, len(numbers)) for w in decontamination.words_of(text)])
    benchmark = [number(r["text"]) for r in items.collect()]
    rows = [
        (i, t)
        for i, t in rows
        if not any(decontamination.align(b, number(t))[0] >= len(b) for b in benchmark)  # half of 2 points a word
    ]
    segmenter = pieces.Segmenter(pieces.read_vocabulary())
    return {i: (segmenter.encode(t).tolist(), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows}


def test_pipeline(spark, folder):
    found = {r["doc_id"]: (r["ids"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, folder).collect()}
    expected = plain_pipeline(spark, folder)
    assert set(found) == set(expected) and found == expected
    assert 0 < len(found) < table(spark, folder, "documents").count()


def test_stages_keep_the_columns(spark, odd, folder):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == odd.columns, name
    assert docs.count() > 0


def test_stages_on_an_empty_table(spark, empty, folder):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.collect() == []
