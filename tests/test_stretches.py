"""One long capture decoded by many tasks."""

import random
from collections import Counter
from decimal import Decimal

import pytest

from edgewright import config
from edgewright.operators import decode
from edgewright.plans import captures, synth

PROFILE = config.load_config().profile("remote-b04287")


@pytest.fixture(scope="module")
def edges(spark):
    """Frames at every place relative to blocks, noise and single pulses between them, long silence, a cut end."""
    rng, t, level, rows = random.Random(6), 1000, 1, []
    size = decode.block_us(PROFILE.rules)

    def put(at, level):
        if not rows or at > rows[-1][0]:
            rows.append((at, level))

    for k in range(70):
        body = [0x2D, 0xD4, 1, k, 3, 4, 0xB0, 0x42, rng.choice([0x87, 0x87, 0x88]), 9, 0x21, 0xAA, 0xAA]
        bits, before = [*config.byte_bits([0xAA, 0xAA]), *config.byte_bits(body), 1], 1
        for i, b in enumerate(bits):
            if b != before:
                put(t + i * 416 + rng.randint(-10, 10), 1 - b)
            before = b
        t += len(bits) * 416
        for _ in range(rng.choice([0, 0, 3, 9])):
            t += rng.choice([50, 416, 2000])
            level = 1 - level
            put(t, level)
        t += rng.choice([9_000, 50_000, 60_000, 5 * size]) + rng.randint(0, size // 7)
    rows = rows[:-1]
    schema = "capture_id string, edge_idx long, t decimal(20,12), level int"
    many = [("long", i, Decimal(at) / 1_000_000, v) for i, (at, v) in enumerate(rows)]
    return spark.createDataFrame([*many, *[(None, *r[1:]) for r in many[:300]], *[("short", *r[1:]) for r in many[:90]]], schema).repartition(5).cache()


def key(df):
    return Counter(tuple(round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in df.select(sorted(set(df.columns) - {"block"})).collect())


def test_stretches_of_any_length_give_the_same_frames(edges):
    want = key(decode.frames(edges, PROFILE, 1 << 40))
    assert sum(want.values()) > 70
    for n in (1, 2, 5):
        assert key(decode.frames(edges, PROFILE, n)) == want, n


def test_a_capture_goes_to_many_tasks(spark, edges):
    rows = decode.marked(edges.where("capture_id = 'long'"), PROFILE.rules, 3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        held = [len(p) for p in rows.rdd.glom().collect() if p]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(held) > 1 and sum(held) > edges.where("capture_id = 'long'").count()
    assert decode.frames(edges.limit(0), PROFILE).count() == 0 == decode.candidates(edges.limit(0), PROFILE).count()


def test_one_decode_for_frames_fragments_and_summary(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").where("o_custkey < 9")
    result = captures.decode_edges(synth.waveform(synth.payloads(orders, PROFILE), PROFILE), PROFILE)
    for df in (result.frames, result.fragments, result.summary):
        assert "MapInArrow" not in df._jdf.queryExecution().toString()
    assert result.summary.agg({"n_valid": "sum"}).first()[0] == orders.count() == result.frames.where("valid").count()
