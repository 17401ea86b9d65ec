import collections
import hashlib
import random

import pytest

from edgewright.llm import substrings as S

SCHEMA = "doc_id long, text string"


def brute(rows, length):
    seen = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = collections.Counter()
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[(d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def made(seed):
    rng = random.Random(seed)
    words = ["ab", "c", "dé", "e f", "g", "hh", "aaaa", "\n"]
    passages = ["".join(rng.choice(words) for _ in range(rng.randint(3, 60))) for _ in range(12)]
    own = lambda: "".join(rng.choice("abcdefghijklmnop é") for _ in range(rng.randint(1, 50)))
    rows = [(i, "".join(rng.choice(passages) if rng.random() < 0.5 else own() for _ in range(rng.randint(0, 6)))) for i in range(150)]
    return [*rows, (300, None), (301, ""), (302, "a" * 500), (303, "ab" * 300), (None, passages[0] * 2), (None, passages[0] * 2), (5, rows[5][1]), (304, "x" * 29)]


@pytest.mark.parametrize(("seed", "length", "gram"), [(1, 30, 8), (2, 30, 8), (3, 31, 8), (4, 17, 5), (5, 40, 20)])
def test_against_brute_force(spark, seed, length, gram):
    rows = made(seed)
    docs = spark.createDataFrame([(*r, b"x", "y") for r in rows], "doc_id long, text string, key binary, run string")
    got = S.without_repeats(docs, length=length, gram=gram, digest=True)
    assert collections.Counter(map(tuple, got.collect())) == brute(rows, length)


def test_documents_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert collections.Counter(map(tuple, S.without_repeats(docs, digest=True).collect())) == brute(rows, 200)


def test_stream_of_many_batches(spark):
    rows = made(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = S.without_repeats(spark.createDataFrame(rows, SCHEMA), length=30, gram=8, digest=True)
        assert collections.Counter(map(tuple, got.collect())) == brute(rows, 30)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_strip_keeps_columns_and_counts(spark):
    same = "x" + "".join(chr(97 + i * 7 % 26) + str(i) for i in range(60))
    rows = [(1, "é" + same, "en", "s", 9, "clash"), (2, same + "ü", None, None, None, "clash"), (3, None, "fr", "s", 0, "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string")
    out = S.strip_repeats(docs, length=100, gram=20)
    assert out.columns == docs.columns
    assert {(r.doc_id, r.text, r.n_chars) for r in out.collect()} == {(1, "é", 1), (2, "ü", 1), (3, None, None)}
    assert S.strip_repeats(docs.limit(0)).count() == 0
