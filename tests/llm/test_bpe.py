"""Byte-pair rounds against the library and against merges done one at a time."""

import hashlib
import random
import unicodedata

import pyarrow as pa
import pytest
from odd import ODD
from pyspark.sql import functions as F

from tablewright.llm import bpe_rounds
from tablewright.llm.common import table
from tablewright.llm.queries import QUERIES


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe_rounds.TOKENIZER_FILE)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe_rounds.read_vocabulary()


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return bpe_rounds.Encoder(vocabulary)


def same(encoder, library, texts):
    ids, counts = encoder.encode(pa.array(texts, pa.string()))
    decoded, low = encoder.decode(ids, counts).to_pylist(), 0
    for text, n, back in zip(texts, counts, decoded, strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids[low : low + n].tolist() == expected, text[:100]
        assert back == library.decode(expected, skip_special_tokens=False)
        low += n


def test_odd_texts_equal_the_library(encoder, library):
    texts = ["", " ", "It's we'll <|endoftext|>ab<|startoftext|> <|endoftext|", "ΑΣ ΟΔΟΣ", "é é ́x", "\x00\x1c\x1f a b"]
    texts += ["x" * 100000, "ab" * 3001, "中文字符一二三 12345 ½ Ⅷ", "İI ß ŉ", "'s'sun 'REally \"'s", " a　b\xa0c", "𝔘𝔫𝔦 👍🏽"]
    same(encoder, library, texts)


def test_random_texts_equal_the_library(encoder, library):
    draw = random.Random(1)
    letters = "abcdefgh'ST reZ12 \n\té中Σ#!<|>endoftxsaŕ"
    same(encoder, library, ["".join(draw.choices(letters, k=draw.randint(0, 60))) for _ in range(3000)])
    old = [chr(c) for c in range(0x110000) if unicodedata.ucd_3_2_0.category(chr(c)) not in ("Cn", "Cs")]
    same(encoder, library, ["".join(draw.choices(old, k=30)) for _ in range(1500)])
    same(encoder, library, ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=4000))])


def test_whole_table_equals_the_library(spark, library, folder):
    got = {r["doc_id"]: r for r in QUERIES["op11_bpe"](spark, folder).collect()}
    docs = table(spark, folder, "documents").select("doc_id", "text").collect()
    for row in docs:
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[row["doc_id"]]["n_tokens"] == len(ids)
        assert got[row["doc_id"]]["ids_sha256"] == hashlib.sha256(packed).hexdigest()
        assert got[row["doc_id"]]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def one_at_a_time(word, ranks):
    """The lowest pair, of equal ones the leftmost, until there is none."""
    word = list(word)
    while True:
        pairs = [(ranks[p][0], i) for i, p in enumerate(zip(word, word[1:])) if p in ranks]
        if not pairs:
            return word
        i = min(pairs)[1]
        word[i : i + 2] = [ranks[word[i], word[i + 1]][1]]


@pytest.mark.parametrize("ordered", [True, False])
def test_rounds_equal_merges_one_at_a_time(ordered):
    draw = random.Random(int(ordered))
    for _ in range(60):
        merges, n = [], 4
        for _ in range(draw.randint(0, 12)):
            merges.append((draw.randrange(n), draw.randrange(n), n))
            n += 1
        if not ordered:
            draw.shuffle(merges)  # parts may be made after they are merged
        merges = list({m[:2]: m for m in merges}.values())
        rounds = bpe_rounds.Rounds(merges, n)
        assert rounds.at_once or not ordered
        ranks = {(a, b): (i, c) for i, (a, b, c) in enumerate(merges)}
        words = [[draw.randrange(4) for _ in range(draw.randint(0, 30))] for _ in range(40)]
        flat = bpe_rounds.np.array([s for w in words for s in w], bpe_rounds.np.int32)
        ids, counts = rounds.merge(flat, bpe_rounds.np.array([len(w) for w in words]))
        expected = [one_at_a_time(w, ranks) for w in words]
        assert ids.tolist() == [s for w in expected for s in w] and counts.tolist() == [len(w) for w in expected]


def test_encode_and_decode_columns(spark, odd, empty, vocabulary, library):
    keyed = odd.withColumn("k", F.monotonically_increasing_id())
    encoded = bpe_rounds.encode_column(keyed, "k", F.col("text"), vocabulary)
    decoded = {r["k"]: r["decoded"] for r in bpe_rounds.decode_column(encoded, "k", vocabulary).collect()}
    for row in keyed.select("k", "text").collect():
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        assert decoded[row["k"]] == library.decode(ids, skip_special_tokens=False)
    given = spark.createDataFrame([(1, [49406, 320, 99999, -1]), (2, None), (3, [])], "k long, ids array<int>")
    back = {r["k"]: r["decoded"] for r in bpe_rounds.decode_column(given, "k", vocabulary).collect()}
    assert back == {1: library.decode([49406, 320], skip_special_tokens=False), 2: "", 3: ""}
    assert bpe_rounds.encode_column(empty, "doc_id", F.col("text"), vocabulary).collect() == []


def test_digests_of_odd_rows(odd, empty):
    rows = bpe_rounds.token_digests(odd).collect()
    assert len(rows) == len(ODD) and {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 5)} == {0}
    assert bpe_rounds.token_digests(empty).collect() == []


def test_remembered_ids_are_bounded(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe_rounds, "REMEMBERED", 50)
    made = bpe_rounds.Encoder(vocabulary)
    for k in range(20):
        same(made, library, [f"some words {k} and {k}more of them", "again the same words"])
        assert len(made.ids) < 200


def test_other_files_are_refused(tmp_path):
    import json

    with open(bpe_rounds.TOKENIZER_FILE) as file:
        said = json.load(file)
    said["normalizer"]["normalizers"].pop()
    (tmp_path / "t.json").write_text(json.dumps(said))
    with pytest.raises(ValueError, match="another way"):
        bpe_rounds.read_vocabulary(str(tmp_path / "t.json"))
