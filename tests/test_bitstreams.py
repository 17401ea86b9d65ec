"""Deduplication of framed bit streams against the sequential rule over whole segments."""

import random
from collections import defaultdict

from edgewright.operators import bitstreams

DDL = "capture_id long, segment int, start_t double, phase_us double, start_bit int, period_us double, valid boolean, complete boolean"


def sequential(rows, tolerance_us):
    kept = []
    for r in sorted(rows, key=lambda r: (r[2], r[3])):
        for at, k in enumerate(kept):
            apart = abs(k[2] - r[2])
            if min(k[4], r[4]) >= 0 and abs(k[4] - r[4]) <= 1 and apart <= max(k[5], r[5]) / 1e6 or apart <= tolerance_us / 1e6:
                wish = lambda x: (not x[6], not x[7], x[2], x[3])
                if wish(r) < wish(k):
                    kept[at] = r
                break
        else:
            kept.append(r)
    return kept


def test_islands_equal_the_sequential_rule(spark):
    pick = random.Random(4)
    rows, parts = [], defaultdict(list)
    for n in range(1500):
        at = pick.choice((1, 1, 1, 2, 3)) * 0.01 + pick.choice((0, 20, 45, 90, 300, 500, 800)) / 1e6 + pick.random() / 1e6
        rows.append((n % 7 or None, n % 60, at, float(pick.randrange(400)), pick.choice((-1, 4, 5, 6)), pick.choice((400.0, 416.0)), pick.choice((True, False, None)), pick.random() < 0.7))
    for r in rows:
        parts[r[0], r[1]].append(r)
    want = {r for part in parts.values() for r in sequential(part, 50.0)}
    found = bitstreams.deduplicated(spark.createDataFrame(rows, DDL), 50.0)
    assert {tuple(r)[:-1] for r in found.collect()} == want
    assert found.columns[-1] == "frame_no" and not bitstreams.deduplicated(spark.createDataFrame([], DDL), 50.0).collect()


def test_only_islands_that_need_the_rule_run_it(spark):
    """Frames that are all each other's duplicates are settled by a window: a table of nothing else sends no row to Python."""
    rows = [(1, n, n + p / 1e6, float(p), 0, 416.0, True, True) for n in range(50) for p in (0, 104, 208)]
    found = bitstreams.deduplicated(spark.createDataFrame(rows, DDL), 50.0)
    assert sorted((r.segment, r.phase_us) for r in found.collect()) == [(n, 0.0) for n in range(50)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter (isnotnull(_simple" in plan and "NOT _simple" in plan[plan.index("FlatMapGroupsInArrow") :]
