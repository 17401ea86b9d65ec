import collections
import random
import re

import numpy as np
import xxhash

from edgewright.llm import exact_dedup, simhash
from edgewright.llm.components import connected_components

ODD = [(1, "a  b"), (2, "a b"), (3, "a\t\nb"), (4, " a b"), (5, None), (6, ""), (None, "a b"), (7, "x"), (7, "x"), (8, "x" * 30_000), (9, "x" * 30_000), (10, " ")]


def odd_docs(spark):
    """Nulls, ties, repeated rows, long texts, and columns whose names clash with the operators' own."""
    rows = [(i, t, "en", "s", 0, True, 5, "z") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept boolean, copies long, prefix string")


def test_exact_dedup_odd_rows(spark):
    got = sorted(map(tuple, exact_dedup.exact_dedup(odd_docs(spark)).select("doc_id", "keep_id", "group_size", "kept").collect()), key=str)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for i, t in ODD:
        groups[norm(t)].append(i)
    want, seen = [], set()
    for i, t in ODD:
        ids = [x for x in groups[norm(t)] if x is not None]
        keep = min(ids) if ids else None
        want.append((i, keep, len(groups[norm(t)]), i == keep and (i, norm(t)) not in seen))
        seen.add((i, norm(t)))
    assert got == sorted(want, key=str)


def test_exact_dedup_empty_and_pipeline_form(spark):
    assert exact_dedup.exact_dedup(odd_docs(spark).limit(0)).count() == 0
    left = exact_dedup.keep_first(odd_docs(spark))
    assert left.columns == odd_docs(spark).columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 4, 5, 7, 8, 10]
    clash = odd_docs(spark).withColumnsRenamed({"kept": "_", "copies": "__x", "lang": "_place"})
    assert sorted(map(tuple, exact_dedup.keep_first(clash).collect())) == sorted(map(tuple, left.collect())) and exact_dedup.keep_first(clash.limit(0)).count() == 0


def brute_fingerprint(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    fps = sorted(set(prints))
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(fps, np.uint64)
    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 4):
            parent[root(fps[i + 1 + j])] = root(f)
    return {f: root(f) for f in fps}


def signed(f):
    return f - (1 << 64) if f >> 63 else f


def test_fingerprints():
    rng = random.Random(2)
    texts = ["", None, " ", "One", "one two", "A b C d", "É é A", "a b c d e a b c d e"]
    texts += [" ".join(rng.choice(["a", "B", "ç", "dd\n", "e\t"]) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    assert [simhash.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 5000, dtype=np.uint64), rng.integers(0, 2**63, 5000, dtype=np.uint64)
    assert (simhash.manhattan(simhash.embedded(a), simhash.embedded(b)) <= np.bitwise_count(a ^ b)).all()
    assert (simhash.manhattan(simhash.embedded(a), simhash.embedded(a)) == 0).all()


def test_links_of_dense_and_sparse_cells(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(200)]
    fps = set(base)
    for b in base[:30]:
        for _ in range(80):
            x = b
            for _ in range(rng.randint(1, 6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    labels = {r[0]: r[1] for r in connected_components(simhash.fingerprint_links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"))).collect()}
    got, want = collections.defaultdict(set), collections.defaultdict(set)
    for f, c in brute_components(fps).items():
        got[labels.get(signed(f), signed(f))].add(f)
        want[c].add(f)
    assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in want.values()}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(200, 200), (7, 3)]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 140)} == {100} and 200 not in got


def test_near_duplicates_against_brute_force(spark):
    docs = odd_docs(spark).select("doc_id", "text").union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("doc_id > 20"))
    rows = docs.collect()
    component = brute_components([brute_fingerprint(r.text) for r in rows])
    smallest = {}
    for r in rows:
        c = component[brute_fingerprint(r.text)]
        if r.doc_id is not None:
            smallest[c] = min(smallest.get(c, r.doc_id), r.doc_id)
    want = collections.Counter((r.doc_id, signed(brute_fingerprint(r.text)), smallest[component[brute_fingerprint(r.text)]]) for r in rows)
    assert collections.Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_keep_one_judges_each_row_by_its_own_text(spark):
    near = lambda n: " ".join(f"word{k}" for k in range(400)) + f" end{n}"
    other = lambda c: " ".join(c + str(k) for k in range(50))
    rows = [(3, near(1)), (5, near(1)), (5, other("b")), (7, near(2)), (None, other("q")), (None, other("q")), (None, near(3)), (9, None), (10, ""), (11, other("r")), (11, other("r"))]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, label string, fp long, key long")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    component = brute_components([brute_fingerprint(t) for _, t in rows])
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[component[brute_fingerprint(t)]].append((i is None, i or 0, t or ""))
    got = collections.Counter((r.doc_id, r.text or "") for r in kept.collect())
    assert len(got) == len(groups) and sum(got.values()) == len(groups) + 2
    for members in groups.values():
        least = min(m[:2] for m in members)
        assert sum(n > 0 for (i, t), n in got.items() if (i is None, i or 0) == least and (i is None, i or 0, t) in members) == 1
    assert got[(5, other("b"))] == 1 and (5, near(1)) not in got and got[(3, near(1))] == 1 and got[(None, other("q"))] == 2
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_cells_over_many_batches(spark):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    fps = {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        links = simhash.fingerprint_links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"))
        labels = connected_components(links).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.node for r in labels} == {signed(f) for f in fps} and len({r.label for r in labels}) == len(set(brute_components(fps).values()))


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_hot_keys_can_be_split(spark):
    """Both sides of a join are sorted straight from a shuffle, so adaptive execution splits a hot length."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "64"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        docs = spark.range(60_000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'one hot text', concat('text ', id)) AS text").repartition(8)
        out = exact_dedup.exact_dedup(docs)
        assert out.where("kept").count() == 40_001
        out.collect()
        assert "skew=true" in plan_of(out)
    finally:
        for k in conf:
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
