"""Long captures: the same rows whatever a block or a range of a file holds."""

import random
from collections import Counter
from decimal import Decimal

import pytest

from edgewright.operators import blocks, coverage, signal
from edgewright.sources import edge_csv

EDGE = "capture_id string, edge_idx long, t long, level int, extra string"


@pytest.fixture(scope="module")
def edges(spark):
    """A long capture with gaps in its numbers (whole blocks are missing), short ones, a null one, equal times."""
    rng, rows = random.Random(2), []
    for name, n in (("long", 900), ("one", 1), ("two", 2), (None, 90), ("x", 40)):
        at, idx = 0, rng.randint(0, 3)
        for _ in range(n):
            rows.append((name, idx, at, rng.randint(0, 1), "e"))
            at += rng.choice([0, 1, 1, 1, 1, 1, 1, 5, 40])
            idx += 1 if rng.random() < 0.97 else rng.choice([2, 60])
    return spark.createDataFrame(rows, EDGE).repartition(6).cache()


def results(edges):
    spans = signal.intervals(edges)
    segments = signal.segments(spans, 0, 5)
    probes = edges.selectExpr("capture_id", "t - 1 + edge_idx % 4 AS probe_t", "extra")
    covers = edges.selectExpr("capture_id", "t AS prelude_t", "t + 1 AS end_t", "edge_idx")
    inside = coverage.frames_in_segments(covers, segments)
    runs = signal.pulse_runs(edges, 1, 1, 2, 5)
    return {
        "intervals": spans.drop("edge_block"), "segments": segments, "runs": runs.drop("edge_block"), "violations": signal.monotonic_violations(edges.withColumn("t", edges.t % 7)).drop("edge_block"),
        "asof": signal.asof(probes, edges), "strict": signal.asof(probes, edges, strict=True), "nearest": signal.nearest_edge(probes, edges, 2), "inside": inside,
        "samples": signal.sampled_levels(spans, segments, 3.0, 2), "gaps": coverage.uncovered(segments, inside.selectExpr("capture_id", "segment", "prelude_t AS cover_start", "end_t AS cover_end")),
    }


def test_blocks_of_any_size_give_the_same_rows(edges, monkeypatch):
    want = {k: Counter(map(str, df.collect())) for k, df in results(edges).items()}
    assert all(want.values())
    for size in (2, 64):
        monkeypatch.setattr(blocks, "BLOCK_EDGES", size)
        for k, df in results(edges).items():
            assert Counter(map(str, df.collect())) == want[k], (size, k)


def test_signal_against_a_plain_loop(edges):
    by = {}
    for r in sorted(edges.collect(), key=lambda r: r.edge_idx):
        by.setdefault(r.capture_id, []).append(r)
    runs, before = Counter(), Counter()
    for name, rows in by.items():
        for i, r in enumerate(rows):
            n = 0
            while n < 5 and i + n + 1 < len(rows) and rows[i + n + 1].t - rows[i + n].t == 1:
                n += 1
            if n >= 2:
                runs[(name, r.edge_idx, n, tuple((float(k), float(rows[i + k].t - r.t)) for k in range(n + 1)))] += 1
            p = r.t - 1 + r.edge_idx % 4
            last = [x for x in rows if x.t <= p]
            before[(name, p, last[-1].t if last else None, last[-1].level if last else None)] += 1
    found = results(edges)
    assert Counter((r.capture_id, r.edge_idx, r.pulses, tuple(map(tuple, r.points))) for r in found["runs"].collect()) == runs
    assert Counter((r.capture_id, r.probe_t, r.prev_t, r.prev_level) for r in found["asof"].collect()) == before


def test_empty_and_null(spark, edges):
    for name, df in results(edges.limit(0)).items():
        assert df.count() == 0, name
    assert signal.asof(spark.createDataFrame([("none", None, "z"), ("long", None, "z")], "capture_id string, probe_t long, extra string"), edges).count() == 2


def test_a_hot_capture_is_many_tasks(spark, monkeypatch):
    """No task of a window gets more than a few blocks of one long capture."""
    monkeypatch.setattr(blocks, "BLOCK_EDGES", 500)
    edges = spark.range(20_000).selectExpr("'hot' AS capture_id", "id AS edge_idx", "id * 2 AS t", "CAST(id % 2 AS INT) AS level")
    for df in (signal.intervals(edges), signal.pulse_runs(edges, 2, 2, 5, 16), signal.asof(edges.selectExpr("capture_id", "t + 1 AS probe_t"), edges)):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        try:
            assert max(len(p) for p in df.rdd.glom().collect()) < 6 * 500
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")
            spark.conf.set("spark.sql.shuffle.partitions", "4")


TEXT = "时间[s],通道 0\r\n" + "".join(f"{Decimal(i) / 100},{i % 2},更多{'长' * (i % 9)}" + ["\n", "\r\n", "\r"][i % 3] for i in range(3000))


@pytest.mark.parametrize("charset", ["GBK", "UTF-8", "UTF-16LE"])
def test_files_cut_anywhere(spark, tmp_path, charset):
    """Ranges of a few bytes (UTF-16 is read whole): lines, numbers and errors are those of the whole file."""
    bad = TEXT.replace("20.5,0", "20.5,7")
    (tmp_path / "a b+%41").mkdir()
    for name, text in (("a b+%41/long.csv", TEXT), ("bad.csv", bad), ("open.csv", "T,L\n1,1"), ("empty.csv", "")):
        (tmp_path / name).write_bytes(text.encode(charset))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "777b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = edge_csv.file_lines(spark, f"file://{tmp_path}", charset)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    rows = edge_csv.checked(lines).cache()
    good = sorted(r[:5] for r in edge_csv.edges_of(rows).collect() if r.capture_id != "open.csv")
    assert good == [("a b+%41/long.csv", i, Decimal(i) / 100, i % 2, i + 2) for i in range(3000)]
    assert {(r.capture_id, r.message) for r in edge_csv.csv_errors(rows).collect()} == {("bad.csv", "第 2052 行: 电平只能是 0 或 1"), ("empty.csv", "第 1 行: 文件没有表头")}
    if charset != "UTF-16LE":
        assert spark.read.text(f"file://{tmp_path}/bad.csv").count() == 3001
    rows.unpersist()
