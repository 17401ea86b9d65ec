import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

from edgewright.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string, phrase string, n long, words int, a long"


@pytest.mark.parametrize("depth", [1, 2, 3, 5])
def test_automaton(depth):
    """Every phrase once, with its count; links lead to the longest suffix with more end places."""
    rng = np.random.default_rng(depth)
    for _ in range(30):
        ids = rng.integers(0, rng.integers(2, 6), rng.integers(0, 60))
        want = Counter(tuple(ids[i : i + k]) for k in range(1, depth + 1) for i in range(len(ids) - k + 1) if (ids[i : i + k] > 0).all())
        a, got = co.automaton(ids, depth), Counter()
        for s in range(len(a.length)):
            for k in range(a.link_length[s] + 1, a.length[s] + 1):
                got[tuple(a.words[:k, s][::-1])] += int(a.count[s])
            t = a.link[s]
            assert t < 0 and a.link_length[s] == 0 or (a.length[t], a.count[t] > a.count[s]) == (a.link_length[s], True)
        assert got == want


def test_automaton_of_many_words():
    """Numbers too large to be packed give the same states."""
    ids = np.random.default_rng(1).integers(0, 4, 200)
    a, b = co.automaton(ids, 3), co.automaton(np.where(ids > 0, ids + (1 << 22), 0), 3)
    assert all((x == y).all() for x, y in zip(a[:4], b[:4], strict=True))


def brute(rows, max_words=3, least=10, share=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text or ""):
            w = re.findall(r"[^\x20\x09]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in piece))
            lang = lang or ("und" if lang is None else lang)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        frequent, found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}, []
        inside = defaultdict(int)
        for p, a in frequent.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        for p, a in frequent.items():
            if p in inside and 100 * inside[p] >= share * a:
                continue
            score, _, left, right = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return out


def odd_rows(n=400):
    """Nulls, empty and very long texts, repeats, every mark and kind of space, letters outside A-Z, ties."""
    rng = random.Random(4)
    words = ["a", "B", "b", "Ça", "ça", "x\x1fy", "\x85", "d e", "of", "the", "Éa", "😀", "-"]
    ends = [" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\r\n", ";", "!? ", ":", "\x0b", "\x0c", " \t "]
    rows = [("".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 60))), rng.choice(["en", "en", "en", None, "und", "fr", ""])) for _ in range(n)]
    return [*rows, (None, "en"), ("", None), (" \t ", "de"), ("...", "de"), ("of the a " * 60_000, "fr"), *[("Only Here and there", "it")] * 12, *[("p q r s", "und")] * 10, ("p q", None)]


@pytest.mark.parametrize(("max_words", "least", "top"), [(3, 10, 2000), (2, 3, 50), (4, 5, 300)])
def test_collocations_against_brute_force(spark, max_words, least, top):
    rows = odd_rows()
    docs = spark.createDataFrame([(i, t, lang, "z", 1, 1, 1) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(5)
    got = co.collocations(docs, max_words=max_words, least=least, top=top, shard_words=5_000)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and {t for c, t in got.dtypes[3:]} == {"bigint"}
    assert Counter(map(tuple, got.collect())) == Counter(brute(rows, max_words, least, 50, top))


def test_no_task_ranks_a_whole_language(spark):
    docs = spark.createDataFrame([(i, t, lang, "z", 1, 1, 1) for i, (t, lang) in enumerate(odd_rows(50))], SCHEMA)
    plan = co.collocations(docs, least=2, shard_words=5_000)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert co.collocations(empty).count() == 0
    assert co.collocations(spark.createDataFrame([(1, None, None, "", 1, 1, 1)], SCHEMA)).count() == 0


def test_products_beyond_64_bits(spark):
    counts = [("en", "a", 8 * 10**12, 1), ("en", "b", 7 * 10**12, 1), ("en", "a b", 6 * 10**12 + 1, 2)]
    (row,) = co.scored(spark.createDataFrame(counts, "lang string, phrase string, a long, words int")).collect()
    assert row.score == 10**6 * (6 * 10**12 + 1) ** 2 // (56 * 10**24)


def test_collocations_equal_sql(spark):
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{Path(sf) / 'documents.parquet'}')")
    want = con.sql(co.ORACLE_SQL["op11_collocations"])
    got = co.op11_collocations(spark, sf)
    at = [want.columns.index(c) for c in got.columns]
    rows = [tuple(r[i] for i in at) for r in want.fetchall()]
    assert len(rows) > 50 and Counter(map(tuple, got.collect())) == Counter(rows)
