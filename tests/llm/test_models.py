"""Quality field, language model and pieces."""

import itertools

import numpy as np
import pytest
from odd import ODD
from pyspark.sql import functions as F

from tablewright.llm import language_id, pieces, quality_crf
from tablewright.llm.common import table
from tablewright.llm.quality_crf import line_features, marginals


def plain_marginals(unary, transition):
    n = len(unary)
    weights = {}
    for path in itertools.product((0, 1), repeat=n):
        score = sum(u * y for u, y in zip(unary, path, strict=True))
        weights[path] = np.exp(score + sum(transition[a, b] for a, b in itertools.pairwise(path)))
    total = sum(weights.values())
    good = [sum(w for p, w in weights.items() if p[i]) / total for i in range(n)]
    pairs = np.zeros((2, 2))
    for p, w in weights.items():
        for a, b in itertools.pairwise(p):
            pairs[a, b] += w / total
    return good, pairs, np.log(total)


def test_marginals_are_those_of_all_paths():
    draw = np.random.default_rng(1)
    chains = [draw.normal(size=n) for n in (3, 1, 5, 5, 2)]
    transition = draw.normal(size=(2, 2))
    chances, pairs, log_z = marginals(chains, transition)
    plain = [plain_marginals(c, transition) for c in chains]
    for chance, (good, _, _) in zip(chances, plain, strict=True):
        assert np.allclose(chance, good)
    assert np.allclose(pairs, sum(p for _, p, _ in plain)) and np.isclose(log_z, sum(z for *_, z in plain))


@pytest.mark.parametrize("text", ["", "\n", "a\n\nB. 1", "Ünï 中文 𝔘!!\n" * 3, "x" * 100000])
def test_line_features(text):
    features, length = line_features(text)
    assert features.shape == (text.count("\n") + 1, quality_crf.N_FEATURES) and np.isfinite(features).all()
    assert length.tolist() == [len(line) for line in text.split("\n")]


@pytest.fixture(scope="module")
def field(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    return quality_crf.fit(docs, table(spark, "/root/testdata/sf0.01", "labels"))


def test_held_out_quality(spark, field):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    scored = quality_crf.score(docs, field).where("held_out").join(labels, "doc_id").collect()
    assert len(scored) > 50
    assert np.mean([r["predicted"] == r["quality"] for r in scored]) >= 0.95


def test_quality_of_odd_rows(odd, empty, field):
    rows = quality_crf.score(odd, field).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert quality_crf.score(empty, field).collect() == []
    kept = quality_crf.of_good_quality(odd, field)
    assert kept.schema == odd.schema and kept.count() == sum(r["predicted"] for r in rows)


def test_quality_without_labels(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    scores = {r["score"] for r in quality_crf.score(odd, quality_crf.fit(odd, labels)).collect()}
    assert scores == {0.5}


def test_held_out_documents_are_not_learned_from(spark, documents):
    docs = documents([(i, f"text {i}") for i in range(200)])
    held = docs.where(quality_crf.is_held_out()).select("doc_id", F.lit(1).alias("quality"))
    field = quality_crf.fit(docs, held)
    assert not field.weights.any()


@pytest.fixture(scope="module")
def model(spark):
    return language_id.fit(table(spark, "/root/testdata/sf0.01", "documents"))


def test_held_out_language(spark, model):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = language_id.predict(docs, model).where("held_out").join(docs, "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.97
    sure = [r["score"] for r in rows]
    assert abs(np.mean(sure) - 1) < 0.1


def test_language_of_odd_rows(odd, empty, model):
    rows = {(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.predict(odd, model).collect()}
    for id_ in (3, 4, 5, 11):
        assert (id_, "und", 0.0) in rows
    assert len(language_id.predict(odd, model).collect()) == len(ODD)
    assert language_id.predict(empty, model).collect() == []
    none = language_id.fit(empty)
    assert {r["lang_pred"] for r in language_id.predict(odd, none).collect()} == {"und"}


def test_ngrams_in_chunks(monkeypatch):
    text = " ".join(f"wörd{i}" for i in range(500))
    whole = language_id.ngram_counts(text)
    monkeypatch.setattr(language_id, "CHUNK", 100)
    assert (language_id.ngram_counts(text) == whole).all()
    n = len(text) + 2
    assert whole.sum() == n + (n - 1) + (n - 2)


def test_temperature_flattens_wrong_certainty():
    sure_but_wrong = [np.array([8.0, 0.0]), np.array([8.0, 0.0])]
    assert language_id.fit_temperature(sure_but_wrong, [0, 1]) > 4
    assert language_id.fit_temperature([], []) == 1.0


@pytest.fixture(scope="module")
def segmenter():
    return pieces.Segmenter(pieces.read_vocabulary())


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(pieces.MODEL_FILE, "rb") as file:
        proto.ParseFromString(file.read())
    proto.trainer_spec.model_type = 1
    for piece in proto.pieces:
        piece.score = max(piece.score, -50000.0)  # else sums in single precision lose small scores
    made = SentencePieceProcessor()
    made.LoadFromSerializedProto(proto.SerializeToString())
    return made


def test_pieces_equal_the_library(spark, segmenter, library):
    texts = [r["text"] for r in table(spark, "/root/testdata/sf0.001", "documents").select("text").collect()]
    words = sorted({w for t in texts for w in t.split()})[:20000]
    assert all(segmenter.encode(w).tolist() == library.encode(w) for w in words)


@pytest.mark.parametrize("text", ["", " ", "  a  b ", "\n\na\tb", "é中𝔘", "x" * 5000, " " * 3000, "a\x00b", "�"])
def test_pieces_round_trip(segmenter, text):
    ids = segmenter.encode(text)
    assert segmenter.decode(ids) == text and (len(ids) > 0) == bool(text)


def test_viterbi_is_the_best_of_all_segmentations():
    names = ["<unk>", "a", "b", "ab", "aba", "ba", "▁", "▁a", "<0x61>"]
    scores = [0, -3.0, -3.0, -4.0, -5.0, -4.5, -1.0, -2.0, 0]
    made = pieces.Segmenter(pieces.Vocabulary(names, scores, {}, 0, frozenset({0, 8})))

    def best(text):
        if not text:
            return 0.0
        ends = [s + best(text[: -len(n)]) for n, s in zip(names[1:8], scores[1:8], strict=True) if text.endswith(n)]
        return max([*ends, -15.0 + best(text[:-1])] if text[-1] not in names else ends)

    for n in range(1, 8):
        for letters in itertools.product("abc", repeat=n):
            text = "▁" + "".join(letters)
            ids = made.viterbi(text)
            total = sum(scores[i] if i else -15.0 for i in ids)
            assert np.isclose(total, best(text))


def test_piece_rows(odd, empty):
    rows = pieces.piece_rows(odd).collect()
    assert len(rows) == len(ODD) and all(r["round_trip"] and r["n_ids"] == len(r["ids"]) for r in rows)
    assert pieces.piece_rows(empty).collect() == []
