"""Documents that are empty, missing or begin with a blank's mark give the same results as the SQL."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from __spark_entry__ import ORACLES, QUERIES
from compare import connect, duck_table, spark_table

TEXTS = ["", None, "_", "__", "__abc", " ", "a", "\n", "__ab", "_a", "___a____", "a_", "the cat sat on the mat", "_ _ _ _ _", "____"]


@pytest.fixture(scope="module")
def odd(folder, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    texts = TEXTS * 8
    rows = {"doc_id": list(range(len(texts))), "text": texts, "lang": ["en"] * len(texts), "source": ["web"] * len(texts)}
    pq.write_table(pa.table(rows), path / "documents.parquet")
    pq.write_table(pq.read_table(f"{folder}/part.parquet"), path / "part.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["mc_accuracy_failed_left_out", "scorer_pandas", "scorer_batched", "evaluate_choices_job"])
def test_scorers_meet_odd_texts(name, spark, odd):
    assert spark_table(QUERIES[name], spark, odd) == duck_table(ORACLES[name], connect(odd))
