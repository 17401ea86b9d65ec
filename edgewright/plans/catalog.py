"""Registered queries of the capture engine and the SQL that states the same result.

``events`` serves as a generic signal: a capture for each user, an edge for each event, its level the parity of the
event's id. ``orders`` gives frames that are encoded to waveforms and decoded again.
"""

from __future__ import annotations

import copy
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..errors import CaptureError
from ..functions import bits
from ..operators import bitstreams, coverage, decode, dedup, signal
from ..sources import edge_csv, report, workbook
from ..storage import cut, option, shared_dir
from . import captures, synth

HOUR = 3_600_000_000
EPOCH_US = 1_704_067_200_000_000  # 2024-01-01, where the events begin
IDLE_US, RUN_US, PROBE_US, COVER_US = 12 * HOUR, 8 * HOUR, HOUR // 2, HOUR
_PROFILE = config.load_config().profile("remote-b04287")
_R = _PROFILE.rules

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL of the same result."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_signal(spark: SparkSession, sf_dir: str, by_id: bool = False) -> DataFrame:
    """edges (capture_id, edge_idx, t in us, level); ``by_id``: in the order of the ids' remainder instead of times."""
    from pyspark.sql import Window

    e = _t(spark, sf_dir, "events")
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    order = Window.partitionBy("user_id").orderBy(F.col("event_id") % 5, "event_id") if by_id else Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("capture_id"), (F.row_number().over(order) - 1).cast("long").alias("edge_idx"), us.alias("t"), (F.col("event_id") % 2).cast("int").alias("level")
    )


def _intervals(spark, sf_dir):
    return signal.intervals(events_signal(spark, sf_dir))


def _segments(spark, sf_dir):
    return signal.segments(_intervals(spark, sf_dir), 0, IDLE_US)


_SIG = """sig AS (SELECT user_id AS capture_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS edge_idx,
  epoch_us(ts) AS t, (event_id % 2)::INTEGER AS level FROM events)"""
_INT = f"""{_SIG}, iv AS (SELECT * FROM (SELECT capture_id, edge_idx, t AS start_t, lead(t) OVER (PARTITION BY capture_id ORDER BY edge_idx) AS end_t, level
  FROM sig) WHERE end_t IS NOT NULL)"""
_SEG = f"""{_INT}, m AS (SELECT *, (level = 0 AND end_t - start_t >= {IDLE_US})::INTEGER AS sep FROM iv),
isl AS (SELECT *, sum(sep) OVER (PARTITION BY capture_id ORDER BY edge_idx) AS island, sum(sep) OVER (PARTITION BY capture_id) AS seps FROM m),
grp AS (SELECT capture_id, island, any_value(seps) AS seps, min(start_t) AS start_t, max(end_t) AS end_t, count(*) AS n_intervals FROM isl
  WHERE sep = 0 GROUP BY capture_id, island),
seg AS (SELECT capture_id, row_number() OVER (PARTITION BY capture_id ORDER BY island) AS segment, start_t, end_t, n_intervals,
  island > 0 AS left_known, island < seps AS right_known FROM grp WHERE start_t < end_t)"""


@query("""WITH s AS (SELECT user_id AS capture_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 5, event_id) - 1 AS edge_idx, epoch_us(ts) AS t FROM events),
l AS (SELECT *, lag(t) OVER (PARTITION BY capture_id ORDER BY edge_idx) AS previous_t FROM s)
SELECT capture_id, edge_idx, t, previous_t FROM l WHERE t < previous_t""")
def edges_monotonic_check(spark, sf_dir):
    return signal.monotonic_violations(events_signal(spark, sf_dir, by_id=True)).select("capture_id", "edge_idx", "t", "previous_t")


@query(f"WITH {_SIG} SELECT capture_id, edge_idx, level, 1 - level AS inverted, level AS direct FROM sig")
def level_mapping(spark, sf_dir):
    e = events_signal(spark, sf_dir)
    return e.select("capture_id", "edge_idx", "level", bits.level_bit(F.col("level"), True).alias("inverted"), bits.level_bit(F.col("level"), False).alias("direct"))


@query(f"WITH {_INT} SELECT capture_id, edge_idx, start_t, end_t, level FROM iv")
def level_intervals(spark, sf_dir):
    return _intervals(spark, sf_dir).drop("edge_block")


@query(f"WITH {_INT} SELECT capture_id, edge_idx, start_t, end_t FROM iv WHERE level = 0 AND end_t - start_t >= {IDLE_US}")
def idle_separators(spark, sf_dir):
    return _intervals(spark, sf_dir).where(signal.idle_separator(0, IDLE_US)).select("capture_id", "edge_idx", "start_t", "end_t")


@query(f"WITH {_SEG} SELECT capture_id, segment::INTEGER AS segment, start_t, end_t, n_intervals, left_known, right_known FROM seg")
def activity_segments(spark, sf_dir):
    return _segments(spark, sf_dir)


@query(f"WITH {_SEG} SELECT capture_id, count(*) FILTER (NOT (left_known AND right_known)) AS at_boundary, count(*) AS n FROM seg GROUP BY capture_id")
def segment_boundary_flags(spark, sf_dir):
    return _segments(spark, sf_dir).groupBy("capture_id").agg(F.count_if(signal.at_file_boundary()).alias("at_boundary"), F.count("*").alias("n"))


_RUNS = f"""{_SIG}, g AS (SELECT *, lead(t) OVER (PARTITION BY capture_id ORDER BY edge_idx) - t AS gap FROM sig),
o AS (SELECT *, coalesce(gap BETWEEN 0 AND {RUN_US}, false) AS one FROM g),
st AS (SELECT *, min(CASE WHEN NOT one THEN edge_idx END) OVER (PARTITION BY capture_id ORDER BY edge_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM o),
run AS (SELECT capture_id, edge_idx, t, least(16, stop - edge_idx) AS pulses FROM st WHERE stop - edge_idx >= 3),
pt AS (SELECT r.capture_id, r.edge_idx, r.pulses, (s.edge_idx - r.edge_idx)::DOUBLE AS x, (s.t - r.t)::DOUBLE AS y FROM run r JOIN sig s
  ON s.capture_id = r.capture_id AND s.edge_idx BETWEEN r.edge_idx AND r.edge_idx + r.pulses),
fit AS (SELECT capture_id, edge_idx, any_value(pulses) AS pulses, regr_slope(y, x) AS slope, regr_intercept(y, x) AS icpt FROM pt
  GROUP BY capture_id, edge_idx),
res AS (SELECT f.*, r.worst FROM fit f JOIN (SELECT p.capture_id, p.edge_idx, max(abs(p.y - f.icpt - f.slope * p.x)) AS worst FROM pt p JOIN fit f
  ON p.capture_id = f.capture_id AND p.edge_idx = f.edge_idx GROUP BY ALL) r ON r.capture_id = f.capture_id AND r.edge_idx = f.edge_idx)"""


def _runs(spark, sf_dir):
    return signal.pulse_runs(events_signal(spark, sf_dir), 0, RUN_US, 3, 16)


@query(f"WITH {_RUNS} SELECT capture_id, edge_idx, pulses::INTEGER AS pulses FROM run")
def pulse_runs(spark, sf_dir):
    return _runs(spark, sf_dir).select("capture_id", "edge_idx", "pulses")


def _fits(spark, sf_dir):
    return _runs(spark, sf_dir).withColumn("fit", bits.ols(F.col("points")))


@query(f"WITH {_RUNS} SELECT capture_id, edge_idx, round(slope / 1000)::BIGINT AS period_ms, round(icpt / 1000)::BIGINT AS offset_ms, (pulses + 1)::INTEGER AS n FROM fit")
def run_ols_fit(spark, sf_dir):
    whole = lambda c: F.round(F.col(c) / 1000).cast("long")
    return _fits(spark, sf_dir).select("capture_id", "edge_idx", whole("fit.slope").alias("period_ms"), whole("fit.intercept").alias("offset_ms"), "fit.n")


@query(f"WITH {_RUNS} SELECT capture_id, edge_idx, round(worst / 1000)::BIGINT AS residual_ms, worst / slope <= 0.5 AS reliable FROM res")
def run_residuals(spark, sf_dir):
    return _fits(spark, sf_dir).select("capture_id", "edge_idx", F.round(F.col("fit.max_residual") / 1000).cast("long").alias("residual_ms"), (F.col("fit.max_residual") / F.col("fit.slope") <= 0.5).alias("reliable"))


@query(f"WITH {_RUNS} SELECT capture_id, edge_idx, k::INTEGER AS phase_no, round(k * slope / 16000)::BIGINT AS phase_ms FROM fit, generate_series(0, 15) g(k)")
def phase_grid(spark, sf_dir):
    fits = _fits(spark, sf_dir).select("capture_id", "edge_idx", F.col("fit.slope").alias("period"))
    return signal.phase_grid(fits, _R.phases).select("capture_id", "edge_idx", "phase_no", F.round(F.col("phase") / 1000).cast("long").alias("phase_ms"))


def _probes(spark, sf_dir, shift=PROBE_US):
    return events_signal(spark, sf_dir).select("capture_id", "edge_idx", (F.col("t") + shift).alias("probe_t"))


_PREV = f"""{_SIG}, nx AS (SELECT *, lead(t) OVER (PARTITION BY capture_id ORDER BY edge_idx) AS next_t FROM sig),
pr AS (SELECT capture_id, edge_idx, t + {PROBE_US} AS probe_t FROM sig),
aj AS (SELECT p.capture_id, p.edge_idx, p.probe_t, n.t AS prev_t, n.level AS prev_level, n.next_t FROM pr p ASOF LEFT
  JOIN nx n ON p.capture_id = n.capture_id AND p.probe_t >= n.t)"""


@query(f"WITH {_PREV} SELECT capture_id, edge_idx, probe_t, prev_t, prev_level, next_t FROM aj")
def asof_level_at(spark, sf_dir):
    return signal.asof(_probes(spark, sf_dir), events_signal(spark, sf_dir))


@query(f"WITH {_PREV} SELECT capture_id, edge_idx, prev_level FROM aj WHERE probe_t < next_t")
def asof_level_contained(spark, sf_dir):
    return signal.asof(_probes(spark, sf_dir), events_signal(spark, sf_dir)).where("probe_t < next_t").select("capture_id", "edge_idx", "prev_level")


@query(f"""WITH {_SIG} SELECT p.capture_id, p.edge_idx, s.t AS prev_t FROM sig p ASOF LEFT JOIN sig s ON p.capture_id = s.capture_id AND p.t > s.t""")
def strict_previous_edge(spark, sf_dir):
    return signal.asof(_probes(spark, sf_dir, 0), events_signal(spark, sf_dir), strict=True).select("capture_id", "edge_idx", "prev_t")


@query(f"""WITH {_PREV}, ah AS (SELECT a.*, f.t AS ahead FROM aj a ASOF LEFT JOIN sig f ON a.capture_id = f.capture_id AND a.probe_t < f.t),
b AS (SELECT *, CASE WHEN prev_t IS NOT NULL AND (ahead IS NULL OR probe_t - prev_t <= ahead - probe_t) THEN prev_t ELSE ahead END AS best FROM ah)
SELECT capture_id, edge_idx, probe_t, CASE WHEN abs(probe_t - best) <= {HOUR} // 4 THEN best END AS nearest_t FROM b""")
def nearest_edge_within(spark, sf_dir):
    return signal.nearest_edge(_probes(spark, sf_dir), events_signal(spark, sf_dir), HOUR // 4)


@query(f"WITH {_PREV} SELECT capture_id, min(least(probe_t - prev_t, next_t - probe_t)) AS least_us FROM aj WHERE probe_t < next_t GROUP BY capture_id")
def min_safety_distance(spark, sf_dir):
    found = signal.asof(_probes(spark, sf_dir), events_signal(spark, sf_dir)).where("probe_t < next_t")
    return found.groupBy("capture_id").agg(F.min(F.least(F.col("probe_t") - F.col("prev_t"), F.col("next_t") - F.col("probe_t"))).alias("least_us"))


@query(f"""WITH {_SEG}, p AS (SELECT s.*, p AS phase_no, start_t + p * {3 * HOUR} AS origin FROM seg s, generate_series(0, 1) g(p)),
r AS (SELECT capture_id, segment, phase_no, k, origin + k * {6 * HOUR} AS sample_us FROM p,
  LATERAL (SELECT unnest(generate_series(0, (end_t - origin - 1) // {6 * HOUR})) AS k) WHERE origin < end_t)
SELECT r.capture_id, segment::INTEGER AS segment, phase_no::INTEGER AS phase_no, k, sample_us, level FROM r ASOF
  JOIN iv ON r.capture_id = iv.capture_id AND r.sample_us >= iv.start_t""")
def fixed_period_samples(spark, sf_dir):
    spans = _intervals(spark, sf_dir)
    rows = signal.sampled_levels(spans, signal.segments(spans, 0, IDLE_US), float(6 * HOUR), 2)
    return rows.select("capture_id", "segment", "phase_no", "k", F.round("sample_t").cast("long").alias("sample_us"), "level")


@query("""WITH b AS (SELECT o_orderkey, printf('AA %02X %02X', (o_orderkey >> 8) & 255, o_orderkey & 255) AS hex, '10101010' || right('0000000000000000' || bin(o_orderkey & 65535), 16) AS bits FROM orders)
SELECT o_orderkey, hex, bits, array_to_string(list_filter(range(24), lambda i: i = 0 OR bits[i + 1] <> bits[i]), ',') AS transitions FROM b""")
def marker_bits(spark, sf_dir):
    """A marker made of AA and two bytes of each order's key: its bits and the places where they change."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit("AA "), bits.byte_hex(F.shiftright(k, 8)), F.lit(" "), bits.byte_hex(k))
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", text.alias("hex")).withColumn("b", bits.bytes_to_bits(bits.hex_to_bytes(F.col("hex"))))
    changes = F.array_join(F.transform(bits.marker_transitions(F.col("b")), lambda x: x.cast("string")), ",")
    return rows.select("o_orderkey", "hex", bits.bit_string(F.col("b")).alias("bits"), changes.alias("transitions"))


@query("""SELECT o_orderkey, printf('%02X %02X', (o_orderkey >> 8) & 255, o_orderkey & 255) AS hex, right('0000000000000000' || bin(o_orderkey & 65535), 16) AS bits FROM orders""")
def bits_bytes_hex(spark, sf_dir):
    key = F.col("o_orderkey")
    two = F.array(F.shiftright(key, 8).bitwiseAND(F.lit(255)).cast("int"), key.bitwiseAND(F.lit(255)).cast("int"))
    b = bits.bytes_to_bits(two)
    return _t(spark, sf_dir, "orders").select("o_orderkey", bits.bytes_hex(bits.bits_to_bytes(b)).alias("hex"), bits.bit_string(b).alias("bits"))


_COMMANDS = "cmd AS (SELECT * FROM (VALUES " + ", ".join(f"({c}, '{ch}', '{a}')" for c, ch, a in _R.commands) + ") v(code, channel, action))"


@query(f"""WITH {_COMMANDS} SELECT coalesce(channel, '{config.UNKNOWN_CHANNEL}') AS channel, coalesce(action, '{config.UNKNOWN_ACTION}') AS action, count(*) AS n
FROM lineitem LEFT JOIN cmd ON (l_orderkey + l_linenumber) % 256 = code GROUP BY ALL""")
def command_lookup(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(F.array_repeat(((F.col("l_orderkey") + F.col("l_linenumber")) % 256).cast("int"), 11).alias("bytes"))
    return decode.with_commands(rows, _R).groupBy("channel", "action").agg(F.count("*").alias("n"))


_PAYLOAD = f"""{_COMMANDS}, k AS (SELECT *, row_number() OVER () - 1 AS no FROM cmd), pay AS (SELECT o_custkey AS capture_id, o_orderkey, k.channel, k.action,
  printf('2D D4 %02X %02X %02X %02X B0 42 87 %02X %02X AA AA', (o_orderkey >> 24) & 255, (o_orderkey >> 16) & 255, (o_orderkey >> 8) & 255, o_orderkey & 255, o_orderkey % 251, k.code) AS hex
  FROM orders JOIN (SELECT *, row_number() OVER (ORDER BY code) - 1 AS n FROM cmd) k ON k.n = o_orderkey % {len(_R.commands)})"""


def _payloads(spark, sf_dir):
    return synth.payloads(_t(spark, sf_dir, "orders"), _PROFILE)


@query(f"""WITH o AS (SELECT o_orderkey, o_orderkey % 6 AS f
  FROM orders) SELECT o_orderkey, CASE f WHEN 1 THEN '{decode.BAD_HEADER}' WHEN 2 THEN '{decode.BAD_ID}' WHEN 3 THEN '{decode.BAD_COMMAND}'
WHEN 4 THEN '{decode.BAD_ID}；{decode.BAD_TAIL}' WHEN 5 THEN '{decode.TRUNCATED}' ELSE '' END AS reasons, f = 0 AS valid FROM o""")
def failure_reasons(spark, sf_dir):
    """Frames with planted faults: header, ID, command, ID and tail, cut short."""
    f, b = F.col("frame_key") % 6, F.col("bytes")
    put = lambda col, at, v: F.transform(col, lambda x, i: F.when(i == at, v).otherwise(x))
    faulty = F.when(f == 1, put(b, 0, 0)).when(f == 2, put(b, 7, 1)).when(f == 3, put(b, 10, 3)).when(f == 4, put(put(b, 8, 0), 12, 0)).when(f == 5, F.slice(b, 1, 12)).otherwise(b)
    rows = _payloads(spark, sf_dir).select("frame_key", bits.bit_string(bits.bytes_to_bits(faulty)).alias("bits"))
    rows = decode.validated(rows, _PROFILE)
    return rows.select(F.col("frame_key").alias("o_orderkey"), F.array_join("reasons", "；").alias("reasons"), "valid")


def _decoded(spark, sf_dir, drop_last=False):
    return captures.decoded(synth.waveform(_payloads(spark, sf_dir), _PROFILE, drop_last), _PROFILE)


@query(f"""WITH {_PAYLOAD} SELECT capture_id, row_number() OVER (PARTITION BY capture_id ORDER BY o_orderkey)::INTEGER AS frame_no, hex, channel, action, true AS valid, 104 AS direct_bits FROM pay""")
def decoded_frames(spark, sf_dir):
    """Every order as a frame: encoded to a jittered waveform, decoded, one row for each physical frame."""
    return _decoded(spark, sf_dir).select("capture_id", "frame_no", bits.bytes_hex(F.col("bytes")).alias("hex"), "channel", "action", "valid", "direct_bits")


@query(f"""WITH {_PAYLOAD} SELECT capture_id, hex, CASE WHEN o_orderkey = max(o_orderkey) OVER (PARTITION BY capture_id) THEN '{decode.EXTENDED}' ELSE '{decode.NOT_NEEDED}' END AS tail_status FROM pay""")
def tail_recovery_status(spark, sf_dir):
    """The closing edge of each capture's last frame is missing; its last bit is recovered."""
    return _decoded(spark, sf_dir, True).select("capture_id", bits.bytes_hex(F.col("bytes")).alias("hex"), "tail_status")


@query(f"WITH {_PAYLOAD} SELECT channel, action, count(*) AS n FROM pay GROUP BY ALL")
def frames_by_channel_action(spark, sf_dir):
    return _decoded(spark, sf_dir).where("valid").groupBy("channel", "action").agg(F.count("*").alias("n"))


@query(f"""WITH {_PAYLOAD} SELECT capture_id, '0xAA' AS c00, '0x2D' AS c01, '0x' || split_part(hex, ' ', 6) AS c06, channel AS c14, action AS c15,
row_number() OVER (PARTITION BY capture_id ORDER BY o_orderkey)::INTEGER AS c16, '{report.VALID}' AS c21, '' AS c22, '104' AS c35, '{report.NOT_APPLICABLE}' AS c37, hex AS c42 FROM pay""")
def result_sheet_view(spark, sf_dir):
    return report.result_view(_decoded(spark, sf_dir), _PROFILE).select("capture_id", "c00", "c01", "c06", "c14", "c15", "c16", "c21", "c22", "c35", "c37", "c42")


@query(f"""WITH {_PAYLOAD}, w AS (SELECT capture_id, '1010101010101010' || array_to_string(list_transform(string_split(hex, ' '), lambda x: right('0000000' || bin(('0x' || x)::INTEGER), 8)), '') || '1' AS bits FROM pay)
SELECT capture_id, sum(len(regexp_extract_all(bits, '0+|1+')) - 1)::BIGINT AS n_edges, count(*) AS n_segments, count(*) AS n_valid, 0::BIGINT AS n_invalid
  FROM w GROUP BY ALL""")
def capture_summary(spark, sf_dir):
    """An edge for each change of a bit, a segment and a valid frame for each order. Where fragments end depends on jitter."""
    result = captures.decode_edges(synth.waveform(_payloads(spark, sf_dir), _PROFILE), _PROFILE)
    return result.summary.select("capture_id", "n_edges", "n_segments", "n_valid", "n_invalid")


@query(f"""WITH {_SIG}, n AS (SELECT *, coalesce((t - lag(t) OVER (PARTITION BY capture_id ORDER BY t) > {6 * HOUR})::INTEGER, 1) AS new FROM sig),
i AS (SELECT *, sum(new) OVER (PARTITION BY capture_id ORDER BY t) AS island FROM n)
SELECT capture_id, island::BIGINT AS island, count(*) AS n, min(t) AS first_t FROM i GROUP BY ALL""")
def dedup_islands(spark, sf_dir):
    e = events_signal(spark, sf_dir)
    return dedup.islands(e, 6 * HOUR, "t").groupBy("capture_id", "island").agg(F.count("*").alias("n"), F.min("t").alias("first_t"))


@query("""WITH c AS (SELECT o_custkey AS capture_id, o_orderkey AS k, 4 - o_orderkey % 4 AS rank, o_orderkey % 2 AS pulses, o_orderkey % 3 AS residual, CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey % 5 END AS safety, o_orderkey % 7 AS period FROM orders)
SELECT capture_id, k AS o_orderkey, rank::INTEGER AS rank FROM c
QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY rank DESC, pulses DESC, residual, safety DESC NULLS LAST, period, k) = 1""")
def dedup_preference(spark, sf_dir):
    """The preferred one of candidates that all lie in one place; every figure that decides varies with the order's key."""
    k = F.col("o_orderkey")
    rows = _t(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("capture_id"), k.alias("edge_idx"), (k % 4 < 2).alias("valid"), (k % 4 == 1).alias("tail_extended"), (k % 4 < 3).alias("complete"), (k % 2).cast("int").alias("pulses"),
        ((k % 3) / 16).cast("double").alias("residual_ratio"), F.when(k % 11 > 0, (k % 5) / 8).cast("double").alias("safety_ratio"), (400 + k % 7).cast("double").alias("period_us"),
        k.cast("double").alias("phase_us"), F.lit(1.0).alias("start_t"), F.lit(1).cast("decimal(20,12)").alias("prelude_t"),
    )
    best = dedup.ranked(dedup.deduplicated(rows, _R))
    return best.select("capture_id", F.col("edge_idx").alias("o_orderkey"), "rank")


_COVER = f"""{_SEG}, fr AS (SELECT capture_id, edge_idx, t AS prelude_t, t + {COVER_US} AS end_t FROM sig),
fs AS (SELECT f.capture_id, f.edge_idx, f.prelude_t, f.end_t, s.segment, s.start_t AS segment_start, s.end_t AS segment_end FROM fr f
  JOIN seg s ON f.capture_id = s.capture_id AND f.prelude_t >= s.start_t AND f.prelude_t < s.end_t),
cl AS (SELECT s.capture_id, s.segment, s.start_t, s.end_t, s.left_known, s.right_known, greatest(f.prelude_t, s.start_t) AS a, least(f.end_t, s.end_t) AS b FROM seg s JOIN fs f USING (capture_id, segment)
  UNION ALL SELECT capture_id, segment, start_t, end_t, left_known, right_known, end_t, NULL FROM seg),
cu AS (SELECT *, greatest(start_t, coalesce(max(b) OVER (PARTITION BY capture_id, segment ORDER BY a, b NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start_t)) AS gap FROM cl)"""


def _frames(spark, sf_dir):
    e = events_signal(spark, sf_dir)
    return e.select("capture_id", "edge_idx", F.col("t").alias("prelude_t"), (F.col("t") + COVER_US).alias("end_t"))


@query(f"WITH {_COVER} SELECT capture_id, edge_idx, prelude_t, end_t, segment::INTEGER AS segment, segment_start, segment_end FROM fs")
def frame_segment_join(spark, sf_dir):
    return coverage.frames_in_segments(_frames(spark, sf_dir), _segments(spark, sf_dir))


@query(f"""WITH {_COVER} SELECT capture_id, segment::INTEGER AS segment, gap AS start_t, a AS end_t, CASE WHEN NOT left_known AND gap = start_t THEN '{coverage.AT_HEAD}'
WHEN NOT right_known AND a = end_t THEN '{coverage.AT_TAIL}' ELSE '{coverage.INSIDE}' END AS reason,
row_number() OVER (PARTITION BY capture_id ORDER BY segment, gap)::INTEGER AS number FROM cu WHERE gap < a""")
def uncovered_ranges(spark, sf_dir):
    segments = _segments(spark, sf_dir)
    return captures.fragments(_frames(spark, sf_dir), segments)


def _document(spark, sf_dir, texts):
    """A configuration for each customer: the one of ``texts`` that its key leads to, with its own bit period, remote and
    idle threshold."""
    k = F.col("c_custkey")
    text = F.get(F.array(*[F.lit(t) for t in texts]), (k % len(texts)).cast("int"))
    own = {'"nominalBitPeriodUs": 416': F.concat(F.lit('"nominalBitPeriodUs": '), (400 + k % 50).cast("string")), '"B0 42 87"': F.concat(F.lit('"b0 '), bits.byte_hex(F.shiftright(k, 8)), F.lit(" "), bits.byte_hex(k), F.lit('"')),
           '"idleThresholdMs": 40': F.concat(F.lit('"idleThresholdMs": '), (40 + k % 5).cast("string"))}
    for old, new in own.items():
        text = F.replace(text, F.lit(old), new)
    return _t(spark, sf_dir, "customer").select("c_custkey", text.alias("text"))


_TEXT = json.dumps(config.DEFAULT_CONFIG, default=float)
_DIRECT = _TEXT.replace('"inverted"', '" DIRECT "').replace('"idleLevel": 0', '"idleLevel": 1')


@query("""SELECT c_custkey, 'remote-b04287' AS config_key, 'NRZ-L 类遥控器（B0 42 87）' AS name, printf('B0 %02X %02X', (c_custkey >> 8) & 255, c_custkey & 255) AS remote_id, 'GBK' AS charset, (40 + c_custkey % 5)::VARCHAR AS idle_threshold_ms,
(c_custkey % 2)::INTEGER AS idle_level, CASE WHEN c_custkey % 2 = 0 THEN 'inverted' ELSE 'direct' END AS level_mapping, 'nrzlDefault' AS rule_key, 'NRZ-L 104 位帧规则' AS rule_name FROM customer""")
def remote_profiles(spark, sf_dir):
    """The profiles of a configuration for each customer, read and resolved where its row is."""
    return config.profiles_of(_document(spark, sf_dir, (_TEXT, _DIRECT)), "c_custkey", "text")


@query("""WITH n AS (SELECT c_custkey, 400 + c_custkey % 50 AS n
  FROM customer), d AS (SELECT c_custkey, n, CASE WHEN n * 8 % 10 = 0 THEN (n * 8 // 10)::VARCHAR ELSE (n * 8 // 10) || '.' || (n * 8 % 10) END AS x,
CASE WHEN n * 12 % 10 = 0 THEN (n * 12 // 10)::VARCHAR ELSE (n * 12 // 10) || '.' || (n * 12 % 10) END AS high FROM n)
SELECT c_custkey, 'nrzlDefault' AS rule_key, section, setting, value FROM d,
  LATERAL (VALUES ('timing', 'nominal_bit_period_us', n::VARCHAR), ('timing', 'prefilter_tolerance_ratio', '0.2'), ('timing', 'min_valid_pulse_count', '5'),
('timing', 'max_initial_fit_pulse_count', '16'), ('timing', 'max_fit_residual_ratio', '0.15'), ('timing', 'tail_edge_tolerance_ratio', '0.35'), ('timing', 'phase_count', '16'), ('timing', 'dedup_tolerance_ratio', '0.5'),
('frame', 'sync_marker_hex', 'AA 2D D4'), ('frame', 'formal_header_hex', '2D D4'), ('frame', 'formal_frame_bits', '104'), ('frame', 'remote_id_byte_offset', '6'), ('frame', 'command_byte_offset', '10'),
('frame', 'tail_byte_offset', '11'), ('frame', 'tail_hex', 'AA AA'), ('derived', 'single_bit_pulse_min_us', x), ('derived', 'single_bit_pulse_max_us', high), ('derived', 'previous_pulse_tolerance_ratio', '0.3'),
('derived', 'formal_frame_bytes', '13'), ('derived', 'sync_prelude_bits', '8'), ('derived', 'sync_inclusive_bits', '112'), ('derived', 'phase_step', 'T_est / 16'),
('derived', 'marker_transitions', '0,1,2,3,4,5,6,7,10,11,12,14,15,18,19,20,21,22')) v(section, setting, value)""")
def protocol_settings(spark, sf_dir):
    """All settings of a configuration for each customer, those derived from its bit period included."""
    return config.settings_of(_document(spark, sf_dir, (_TEXT,)), "c_custkey", "text")


def _csv_text(spark, sf_dir, faults=False):
    """The signal as decoded lines of CSV files, with a header each; ``faults`` breaks a line in some captures."""
    e = events_signal(spark, sf_dir).withColumn("t", F.col("t") - EPOCH_US)
    text = F.concat_ws(",", (F.col("t").cast("decimal(20,0)") * F.expr("CAST(0.000001 AS DECIMAL(7,6))")).cast("string"), F.col("level").cast("string"))
    if faults:
        hit = (F.col("edge_idx") == 3) & (F.col("capture_id") % 5 == 0)
        bad = F.element_at(F.array(F.lit("1.5"), F.lit("x,1"), F.lit("1.0,2"), F.lit("0.5,1")), (F.col("capture_id") / 5 % 4).cast("int") + 1)
        text = F.when(hit, bad).otherwise(text)
    body = e.select("capture_id", (F.col("edge_idx") + 2).alias("line"), text.alias("text"))
    head = e.select("capture_id").distinct().select("capture_id", F.lit(1).cast("long").alias("line"), F.lit("Time[s],Channel 0").alias("text"))
    return head.unionByName(body)


def _csv_lines(spark, sf_dir, faults=False):
    return edge_csv.text_lines(_csv_text(spark, sf_dir, faults))


@query(f"WITH {_SIG} SELECT capture_id, edge_idx, t - {EPOCH_US} AS t_us, level, edge_idx + 2 AS source_line FROM sig")
def csv_edge_scan(spark, sf_dir):
    e = edge_csv.edges_of(edge_csv.checked(_csv_lines(spark, sf_dir)))
    return e.select("capture_id", "edge_idx", (F.col("t") * 1_000_000).cast("long").alias("t_us"), "level", "source_line")


@query(f"""WITH {_SIG} SELECT capture_id, 5::BIGINT AS source_line, '第 5 行: ' || CASE (capture_id // 5) % 4 WHEN 0 THEN '至少需要时间和电平两列' WHEN 1 THEN '时间不是合法数值' WHEN 2 THEN '电平只能是 0 或 1' ELSE '时间不能倒退' END AS message
FROM sig WHERE edge_idx = 3 AND capture_id % 5 = 0""")
def csv_error_lines(spark, sf_dir):
    return edge_csv.csv_errors(edge_csv.checked(_csv_lines(spark, sf_dir, True)))


@query(f"""WITH {_SIG} SELECT capture_id, edge_idx, t - {EPOCH_US} AS t_us, level, edge_idx + 2 AS source_line FROM sig WHERE capture_id % 7 <> 0""")
def csv_file_scan(spark, sf_dir):
    """The signal written as one file for each capture and read again; every seventh file has a header of one column."""
    rows, path = _csv_text(spark, sf_dir), f"{shared_dir(spark)}/captures"
    rows = rows.withColumn("text", F.when((F.col("line") == 1) & (F.col("capture_id") % 7 == 0), "Time[s]").otherwise(F.col("text")))
    rows = rows.repartition("capture_id").sortWithinPartitions("capture_id", "line")
    rows.select("capture_id", "text").write.partitionBy("capture_id").option("lineSep", "\r\n").text(path)
    e = edge_csv.edges_of(cut(edge_csv.checked(edge_csv.file_lines(spark, f"{path}/capture_id=*")), "lines"))
    e = e.withColumn("capture_id", F.regexp_extract("capture_id", "capture_id=([0-9]+)/", 1).cast("long"))
    return e.select("capture_id", "edge_idx", (F.col("t") * 1_000_000).cast("long").alias("t_us"), "level", "source_line")


@query(f"""WITH {_SIG} SELECT capture_id || '.csv' AS capture_id, CASE capture_id % 6 WHEN 4 THEN 3 ELSE 1 END::BIGINT AS source_line, '第 ' || CASE capture_id % 6 WHEN 4 THEN 3 ELSE 1 END || ' 行: '
|| CASE capture_id % 6 WHEN 4 THEN '至少需要时间和电平两列' ELSE '表头至少需要两列且不能为空' END AS message FROM sig WHERE capture_id % 6 IN (1, 2, 3, 4) GROUP BY ALL""")
def csv_header_faults(spark, sf_dir):
    """Files in GBK: header of one column, an empty cell, no text at all, a blank line; and two good ones, one of them
    with old line ends."""
    k, say = F.col("capture_id") % 6, lambda head, end="\n", more="": F.lit(f"{head}{end}0.1,1{end}{more}0.2,0{end}")
    body = F.when(k == 1, say("时间")).when(k == 2, say("时间, ")).when(k == 3, F.lit(" ")).when(k == 4, say("时间,电平", more="\n")).when(k == 5, say("时间,电平", "\r")).otherwise(say("时间[s],通道 0"))
    with option(spark, "spark.sql.legacy.javaCharsets", "true"):
        files = events_signal(spark, sf_dir).select("capture_id").distinct().select(F.format_string("x/%s.csv", "capture_id").alias("path"), F.encode(body, "GBK").alias("content"))
    return edge_csv.csv_errors(edge_csv.checked(edge_csv.lines_of(files, "GBK")))


@query(f"""WITH {_COVER}, f AS (SELECT capture_id, count(*) FILTER (level = 1) AS n_valid, count(*) FILTER (level = 0) AS n_invalid FROM sig GROUP BY ALL),
g AS (SELECT capture_id, count(*) AS n FROM cu WHERE gap < a GROUP BY ALL), s AS (SELECT capture_id, count(*) AS n FROM seg GROUP BY ALL)
SELECT f.capture_id, n_valid + n_invalid AS n_edges, coalesce(s.n, 0)::BIGINT AS n_segments, n_valid, n_invalid, coalesce(g.n, 0)::BIGINT AS n_fragments
  FROM f LEFT JOIN s USING (capture_id) LEFT JOIN g USING (capture_id)""")
def summary_counts(spark, sf_dir):
    """All five counts of a summary over the signal; an edge at level 1 stands for a valid frame."""
    e, segments = events_signal(spark, sf_dir), _segments(spark, sf_dir)
    made = e.select("capture_id", F.col("t").alias("prelude_t"), (F.col("t") + COVER_US).alias("end_t"), (F.col("level") == 1).alias("valid"))
    return captures.summary(e, segments, made, captures.fragments(made, segments))


#: The summary's rows for counts n_edges, ... of a table c.
_SUMMARY_ROWS = """(VALUES (1, c.capture_id::VARCHAR), (2, n_edges::VARCHAR), (3, n_segments::VARCHAR), (4, n_valid::VARCHAR), (5, n_invalid::VARCHAR), (6, n_fragments::VARCHAR), (7, 'B0 42 87'),
(8, '332.80～499.20'), (9, '同步前导连续边沿初步拟合，确认AA 2D D4后按已知跳变位置细化拟合'), (10, 'T_est / 16'), (11, '两个候选中较大T_est的1/2'), (12, '40'), (13, '0'),
(14, '反相映射（CSV 0 -> 1，CSV 1 -> 0）'), (15, '2024-01-01 00:00:00')) v(no, value)"""
_COUNTS = ORACLE_SQL["summary_counts"]
_AT = "2024-01-01 00:00:00"


@query(f"SELECT capture_id, no::INTEGER AS no, value FROM ({_COUNTS}) c, LATERAL {_SUMMARY_ROWS}")
def summary_sheet_view(spark, sf_dir):
    """The rows of the summary sheet of the signal's captures."""
    return report.summary_view(summary_counts(spark, sf_dir), _PROFILE, _AT).select("capture_id", F.col("no").cast("int").alias("no"), "value")


def _made_frames(spark, sf_dir):
    """A frame for each order, every figure of the report varying with its key; every fifth is cut short."""
    k, r = F.col("frame_key"), _PROFILE.rules
    eighths = lambda n: ((k % n) / 8).cast("double")
    rows = _payloads(spark, sf_dir).withColumn("bytes", F.when(k % 5 == 0, F.slice("bytes", 1, 12)).otherwise(F.col("bytes")))
    rows = rows.withColumn("bits", bits.bit_string(bits.bytes_to_bits(F.col("bytes"))))
    at = (k / 8).cast("double")
    figures = {
        "prelude_t": at.cast("decimal(20,12)"), "associated_t": F.when(k % 3 > 0, (at + 0.5).cast("decimal(20,12)")), "start_t": at + 0.25, "end_t": at + 0.75, "edge_idx": k,
        "period_us": F.when(k % 7 > 0, 400 + eighths(64)), "pulses": (5 + k % 12).cast("int"), "initial_period_us": 400 + eighths(48), "initial_residual_us": eighths(40),
        "initial_residual_ratio": eighths(3), "initial_threshold_us": 60 + eighths(9), "residual_us": eighths(41), "residual_ratio": eighths(5), "threshold_us": 61 + eighths(11),
        "phase_us": eighths(400), "phase_step_us": 25 + eighths(8), "direct_bits": F.when(k % 11 == 0, -1).otherwise(104 - k % 3).cast("int"), "final_bits": F.length("bits"),
        "tail_deviation_us": F.when(k % 2 == 0, eighths(16) - 1), "tail_tolerance_us": F.when(k % 2 == 0, 145 + eighths(8)), "previous_pulse_error_us": F.when(k % 4 == 0, eighths(24)),
        "tail_status": F.when(k % 2 == 0, decode.EXTENDED).otherwise(decode.NOT_NEEDED), "tail_extended": k % 2 == 0,
    }
    return dedup.numbered(decode.validated(rows.withColumns(figures), _PROFILE))


def _result_sql() -> str:
    """The 43 columns of those frames."""
    e = lambda n: f"((k % {n}) / 8.0)::DOUBLE"
    shown = lambda x: f"coalesce(CASE WHEN {x} >= 0 THEN ({x})::VARCHAR END, '{report.NOT_APPLICABLE}')"
    octet = lambda i: f"CASE WHEN {i} < 12 OR k % 5 > 0 THEN '0x' || split_part(hex, ' ', {i + 1}) ELSE '{report.NOT_RECOVERED}' END"
    tail = "CASE WHEN k % 2 = 0 THEN "
    cells = [
        "'0xAA'", *[octet(i) for i in range(13)], "channel", "action", "row_number() OVER (PARTITION BY capture_id ORDER BY k)::INTEGER",
        "k / 8.0::DOUBLE", "CASE WHEN k % 3 > 0 THEN k / 8.0::DOUBLE + 0.5 END", "k / 8.0::DOUBLE + 0.25", "k / 8.0::DOUBLE + 0.75",
        f"CASE WHEN k % 5 > 0 THEN '{report.VALID}' ELSE '{report.INVALID}' END", f"CASE WHEN k % 5 > 0 THEN '' ELSE '{decode.TRUNCATED}' END",
        f"CASE WHEN k % 7 > 0 THEN (400 + {e(64)})::VARCHAR ELSE '{report.NOT_ESTIMATED}' END", "'同步前导连续1T边沿初始拟合，确认AA 2D D4后按已知跳变位置细化拟合并重新采样验证'",
        "(5 + k % 12)::INTEGER", f"400 + {e(48)}", e(40), e(3), f"60 + {e(9)}", e(41), e(5), f"61 + {e(11)}", e(400), f"25 + {e(8)}",
        shown("CASE WHEN k % 11 = 0 THEN -1 ELSE 104 - k % 3 END"), "CASE WHEN k % 5 > 0 THEN '104' ELSE '96' END",
        shown(f"{tail}{e(16)} - 1 END"), shown(f"{tail}145 + {e(8)} END"), shown(f"CASE WHEN k % 4 = 0 THEN {e(24)} END"), f"{tail}'{decode.EXTENDED}' ELSE '{decode.NOT_NEEDED}' END",
        "array_to_string(list_transform(string_split(CASE WHEN k % 5 > 0 THEN hex ELSE left(hex, 35) END, ' '), lambda x: right('0000000' || bin(('0x' || x)::INTEGER), 8)), '')",
        "CASE WHEN k % 5 > 0 THEN hex ELSE left(hex, 35) END",
    ]
    return f"WITH {_PAYLOAD} SELECT capture_id, " + ", ".join(f"{c} AS c{i:02}" for i, c in enumerate(cells)) + " FROM (SELECT *, o_orderkey AS k FROM pay)"


@query(_result_sql())
def result_sheet_columns(spark, sf_dir):
    """All 43 columns of the result sheet."""
    view = report.result_view(_made_frames(spark, sf_dir), _PROFILE)
    return view.withColumns({c: F.col(c).cast("double") for c in ("c17", "c18")})


def _read_back(spark, results, summary, fragments, sheet):
    """(capture_id, row, cells) of a sheet of the workbooks that the three views give."""
    path = f"{shared_dir(spark)}/books"
    workbook.save(results, summary, fragments, path)
    read = workbook.read_rows(spark, path).where(F.col("sheet") == sheet)
    return read.select(F.regexp_extract("file", "([0-9]+)[^/]*$", 1).cast("long").alias("capture_id"), "row", "cells")


def _named(view):
    """A view whose captures are file names, as workbooks are named by them."""
    return view.withColumn("capture_id", F.concat(F.col("capture_id").cast("string"), F.lit(".csv")))


@query(f"WITH r AS ({_result_sql()}) SELECT capture_id, (c16 + 2)::INTEGER AS row, " + ", ".join(f"c{i:02}::VARCHAR AS c{i:02}" for i in range(43)) + " FROM r")
def workbook_results(spark, sf_dir):
    """The frames of every capture written as a workbook from the task that holds them, and read back cell by cell."""
    frames = _made_frames(spark, sf_dir)
    counts = frames.groupBy("capture_id").agg(F.count("*").alias("n_edges")).selectExpr("*", "1 AS n_segments", "0 AS n_valid", "0 AS n_invalid", "0 AS n_fragments")
    none = spark.createDataFrame([], "capture_id string, number int, start_t double, end_t double, reason string")
    rows = _read_back(spark, _named(report.result_view(frames, _PROFILE)), _named(report.summary_view(counts, _PROFILE, _AT)), none, report.RESULT_SHEET)
    return rows.where("row > 2").select("capture_id", "row", *[F.get("cells", F.lit(i)).alias(f"c{i:02}") for i in range(43)])


@query(f"""WITH s AS (SELECT capture_id, no, value FROM ({_COUNTS}) c,
  LATERAL {_SUMMARY_ROWS}), g AS (SELECT capture_id, start_t / 4096.0 AS a, end_t / 4096.0 AS z, reason, number FROM ({ORACLE_SQL['uncovered_ranges']})),
l AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{x}')" for i, x in enumerate(report.SUMMARY, 1))}) v(no, label))
SELECT s.capture_id, no::INTEGER AS row, label AS a, CASE no WHEN 1 THEN value || '.csv' ELSE value END AS b, NULL::VARCHAR AS c, NULL::VARCHAR AS d
  FROM s JOIN l USING (no)
UNION ALL SELECT DISTINCT capture_id, 16, '未识别与边界诊断', NULL, NULL, NULL FROM s
UNION ALL SELECT DISTINCT capture_id, 17, '序号', '起始时间[s]', '结束时间[s]', '原因' FROM s
UNION ALL SELECT capture_id, 17 + number, number::VARCHAR, (a - 415000000000)::DOUBLE::VARCHAR, (z - 415000000000)::DOUBLE::VARCHAR, reason FROM g""")
def workbook_summary(spark, sf_dir):
    """Summary and fragments of the signal's captures written as workbooks and read back; times in units of 4096 us."""
    segments = _segments(spark, sf_dir)
    gaps = captures.fragments(_frames(spark, sf_dir), segments)
    time = lambda c: (F.col(c) / 4096 - 415_000_000_000).cast("double").alias(c)
    gaps = gaps.select("capture_id", "number", time("start_t"), time("end_t"), "reason")
    results = report.result_view(_made_frames(spark, sf_dir), _PROFILE).limit(0)
    view = report.summary_view(summary_counts(spark, sf_dir), _PROFILE, _AT)
    named = F.when(F.col("no") == 1, F.concat("value", F.lit(".csv"))).otherwise(F.col("value"))
    rows = _read_back(spark, _named(results), _named(view.withColumn("value", named)), _named(gaps), report.SUMMARY_SHEET)
    return rows.select("capture_id", "row", *[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate("abcd")])


_TAILS = (decode.EXTENDED, decode.TOO_SHORT, decode.NO_EDGE, decode.BAD_EDGE)


@query("SELECT o_orderkey, CASE o_orderkey % 4 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(_TAILS)) + " END AS status FROM orders")
def tail_outcomes(spark, sf_dir):
    """One frame for each order without its closing edge, and the edge that begins its last bit there, absent, early
    or late: whether some phase's tail comes to what that calls for, else all that came."""
    from pyspark.sql import Window

    sent = _payloads(spark, sf_dir).select(F.col("frame_key").alias("capture_id"), "frame_key", "bytes")
    e = synth.waveform(sent, _PROFILE)
    e = e.withColumn("back", F.count("*").over(Window.partitionBy("capture_id")) - F.col("edge_idx"))
    kind = F.col("capture_id") % 4
    e = e.where((F.col("back") > 1) & ~((kind == 1) & (F.col("back") == 2)))
    late = F.when((F.col("back") == 2) & (kind == 2), -270).when((F.col("back") == 2) & (kind == 3), 290).otherwise(0)
    e = e.withColumn("t", (F.col("t") + late.cast("decimal(6,0)") * F.expr("CAST(0.000001 AS DECIMAL(7,6))")).cast("decimal(20,12)"))
    found = decode.candidates(e, _PROFILE, ("tail_status",)).groupBy("capture_id").agg(F.sort_array(F.collect_set("tail_status")).alias("all"))
    due = F.get(F.array(*[F.lit(x) for x in _TAILS]), kind.cast("int"))
    return found.select(F.col("capture_id").alias("o_orderkey"), F.when(F.array_contains("all", due), due).otherwise(F.array_join("all", "；")).alias("status"))


def _streams(spark, sf_dir):
    """Two frames in a row as one stream of bits, the second one cut for every third order."""
    rows = _payloads(spark, sf_dir).withColumn("b", bits.bit_string(bits.bytes_to_bits(F.concat(F.array(F.lit(0xAA)), "bytes"))))
    cut = F.when(F.col("frame_key") % 3 == 0, F.substring("b", 1, 60)).otherwise(F.col("b"))
    return rows.select(
        "capture_id", F.col("frame_key").cast("int").alias("segment"), F.lit(0.0).alias("phase_us"), F.concat(F.lit("00"), "b", F.lit("0110"), cut).alias("bits"), F.lit(1.0).alias("first_t"), F.lit(416.0).alias("period_us"),
        F.lit(1.0).alias("start_t"), F.lit(9.0).alias("end_t"),
    )


@query(f"""WITH {_PAYLOAD} SELECT o_orderkey::INTEGER AS segment, s AS start_bit, s = 2 OR o_orderkey % 3 <> 0 AS valid, CASE WHEN s = 2 OR o_orderkey % 3 <> 0 THEN 'AA ' || hex ELSE left('AA ' || hex, 20) END AS hex,
CASE WHEN s = 2 OR o_orderkey % 3 <> 0 THEN '' ELSE '{decode.CORE_TRUNCATED}' END AS reasons FROM pay, (VALUES (2), (118)) v(s)""")
def bit_stream_frames(spark, sf_dir):
    found = bitstreams.framed(_streams(spark, sf_dir), _PROFILE)
    return found.select("segment", "start_bit", "valid", bits.bytes_hex(F.col("bytes")).alias("hex"), F.array_join("reasons", "；").alias("reasons"))


@query("SELECT o_orderkey::INTEGER AS segment, CASE WHEN o_orderkey % 3 = 0 THEN 178 ELSE 230 END AS n_bits, '未找到识别开头' AS reason, false AS valid FROM orders")
def bit_stream_unmatched(spark, sf_dir):
    found = bitstreams.unmatched(_streams(spark, sf_dir))
    return found.select("segment", F.length("bits").alias("n_bits"), F.element_at("reasons", 1).alias("reason"), "valid")


@query(f"""WITH {_COVER}, g AS (SELECT capture_id, segment, min(prelude_t) AS a, arg_max(end_t, prelude_t) AS z FROM fs GROUP BY ALL),
b AS (SELECT s.*, g.a, g.z FROM seg s LEFT JOIN g USING (capture_id, segment) WHERE NOT (left_known AND right_known))
SELECT capture_id, segment::INTEGER AS segment, start_t::DOUBLE AS start_t, end_t::DOUBLE AS end_t, '{bitstreams.EDGE_UNMATCHED}' AS reason FROM b
  WHERE a IS NULL
UNION ALL SELECT capture_id, segment::INTEGER, start_t::DOUBLE, a::DOUBLE, '{bitstreams.HEAD_PIECE}' FROM b WHERE NOT left_known AND start_t < a
UNION ALL SELECT capture_id, segment::INTEGER, z::DOUBLE, end_t::DOUBLE, '{bitstreams.TAIL_PIECE}' FROM b
  WHERE a IS NOT NULL AND NOT right_known AND z < end_t""")
def boundary_fragments(spark, sf_dir):
    segments = _segments(spark, sf_dir)
    inside = coverage.frames_in_segments(_frames(spark, sf_dir), segments)
    return bitstreams.boundary_fragments(segments, inside.select("capture_id", "segment", F.col("prelude_t").alias("cover_start"), F.col("end_t").alias("cover_end")))


@query("""SELECT o_custkey AS capture_id, count(*) AS n, max(o_orderkey)::INTEGER AS last_segment FROM orders GROUP BY ALL""")
def bit_stream_dedup(spark, sf_dir):
    """Each order's frame seen at three phases within one period: one stays."""
    rows = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("capture_id"), F.col("o_orderkey").cast("int").alias("segment"), F.explode(F.array(*[F.lit(float(p)) for p in (0, 104, 208)])).alias("phase_us"))
    rows = rows.select("*", F.lit(0).alias("start_bit"), F.lit(416.0).alias("period_us"), F.lit(True).alias("valid"), F.lit(True).alias("complete"), (F.col("segment") + F.col("phase_us") / 1e6).alias("start_t"))
    best = bitstreams.deduplicated(rows, 50.0)
    return best.groupBy("capture_id").agg(F.count("*").alias("n"), F.max("segment").alias("last_segment"))


@query(f"""WITH {_PAYLOAD} SELECT channel, regexp_extract(channel, '([0-9]+)', 1)::INTEGER AS channel_no, string_agg(DISTINCT split_part(hex, ' ', 11), ' ' ORDER BY split_part(hex, ' ', 11)) AS codes, count(*) AS n FROM pay GROUP BY ALL""")
def commands_by_channel(spark, sf_dir):
    """The commands that the orders' frames send, by channel: their codes in order and how many frames."""
    sent = decode.with_commands(_payloads(spark, sf_dir), _R).withColumn("code", F.get("bytes", F.lit(_R.command_at)))
    codes = F.array_join(F.transform(F.sort_array(F.collect_set("code")), bits.byte_hex), " ")
    return sent.groupBy("channel").agg(codes.alias("codes"), F.count("*").alias("n")).withColumn("channel_no", F.regexp_extract("channel", "([0-9]+)", 1).cast("int"))


#: A change of one field of the shipped configuration (its path and new value) that breaks a rule; the message names it.
_BROKEN = (
    ("schemaVersion", 2), ("remoteConfigs", []), ("protocolRuleSets", None), ("extra", 1), ("remoteConfigs.0.key", " "), ("remoteConfigs.0.name", None),
    ("remoteConfigs.0.remoteId", "B0 42"), ("remoteConfigs.0.charset", "no-such"), ("remoteConfigs.0.charset", "rot13"), ("remoteConfigs.0.idleThresholdMs", 0),
    ("remoteConfigs.0.idleLevel", 2), ("remoteConfigs.0.levelMapping", "other"), ("remoteConfigs.0.protocolRuleKey", "none"), ("remoteConfigs.0.more", 1),
    ("protocolRuleSets.0.timing.nominalBitPeriodUs", 0), ("protocolRuleSets.0.timing.prefilterToleranceRatio", 1), ("protocolRuleSets.0.timing.minValidPulseCount", 0),
    ("protocolRuleSets.0.timing.maxInitialFitPulseCount", 1), ("protocolRuleSets.0.timing.tailEdgeToleranceRatio", 0.5), ("protocolRuleSets.0.timing.phaseCount", 1),
    ("protocolRuleSets.0.timing.dedupToleranceRatio", None), ("protocolRuleSets.0.frame.syncMarkerHex", "AA"), ("protocolRuleSets.0.frame.formalHeaderHex", "2D D5"),
    ("protocolRuleSets.0.frame.formalFrameBits", 96), ("protocolRuleSets.0.frame.remoteIdByteOffset", 5), ("protocolRuleSets.0.frame.commandByteOffset", 9),
    ("protocolRuleSets.0.frame.tailByteOffset", 12), ("protocolRuleSets.0.frame.tailHex", "AA"), ("protocolRuleSets.0.commands", []), ("protocolRuleSets.0.commands.0.code", "GG"),
    ("protocolRuleSets.0.commands.0.channel", ""), ("protocolRuleSets.0.commands.0.action", None),
)


def _broken(path: str, value) -> str:
    """The shipped configuration with one field changed, as JSON."""
    document = copy.deepcopy(config.DEFAULT_CONFIG)
    at, *rest = (int(x) if x.isdigit() else x for x in reversed(path.split(".")))
    inner = document
    for k in reversed(rest):
        inner = inner[k]
    inner[at] = value
    return json.dumps(document, default=float)


def _twice(path: str) -> str:
    """The same with one entry of a list repeated."""
    document = copy.deepcopy(config.DEFAULT_CONFIG)
    inner = document
    for k in path.split("."):
        inner = inner[int(k) if k.isdigit() else k]
    inner.append(inner[0])
    return json.dumps(document, default=float)


#: Documents by what is wrong with them: a field, a repeated entry, text that is no JSON, nothing.
_DOCUMENTS = [
    *[(path, path.rsplit(".", 1)[-1], _broken(path, value)) for path, value in _BROKEN], *[(p, p.rsplit(".", 1)[-1], _twice(p)) for p in ("remoteConfigs", "protocolRuleSets", "protocolRuleSets.0.commands")],
    ("no JSON", "", "{" + _TEXT), ("null", "", "null"), ("good", "", _TEXT),
]


@query(f"""WITH v AS (SELECT * FROM (VALUES {', '.join(f"({n}, '{what}', '{'OK' if what == 'good' else 'CONFIG_INVALID'}', '{field}')" for n, (what, field, _) in enumerate(_DOCUMENTS))}) v(n, what, code, field))
SELECT c_custkey, what, code, CASE WHEN field <> '' THEN true END AS named FROM customer JOIN v ON n = c_custkey % {len(_DOCUMENTS)}""")
def config_rules(spark, sf_dir):
    """A configuration for each customer, one rule broken in all but some: the code of the error, and whether it names
    the field."""
    k, size = F.col("c_custkey"), len(_DOCUMENTS)
    rows = config.outcomes_of(_document(spark, sf_dir, [text for _, _, text in _DOCUMENTS]), "c_custkey", "text")
    what, field = (F.get(F.array(*[F.lit(d[i]) for d in _DOCUMENTS]), (k % size).cast("int")) for i in (0, 1))
    return rows.select("c_custkey", what.alias("what"), "code", F.when(field != "", F.contains("message", field)).alias("named"))


@query(r"""WITH f AS (SELECT o_orderkey, o_orderkey % 8 AS c, o_orderkey * 7919 % 30000000 AS size, o_orderkey::VARCHAR AS k FROM orders),
n AS (SELECT o_orderkey, size, CASE c WHEN 0 THEN k || '.csv' WHEN 1 THEN 'x/y\' || k || '.CSV' WHEN 2 THEN '/' || k || '.csv ' WHEN 3 THEN k || '.txt' WHEN 4 THEN '.csv' WHEN 5 THEN ' ' WHEN 6 THEN k || '.csv/' ELSE k || '.Csv' END AS name,
  CASE c WHEN 1 THEN k || '.CSV' WHEN 7 THEN k || '.Csv' ELSE k || '.csv' END AS bare, c IN (0, 1, 2, 7) AND size > 0 AS ours FROM f)
SELECT o_orderkey, name, size, CASE WHEN NOT ours THEN 'INVALID_REQUEST' WHEN size > 20971520 THEN 'UPLOAD_TOO_LARGE' ELSE bare END AS outcome FROM n""")
def upload_checks(spark, sf_dir):
    """What becomes of a listing of uploads, one named after each order: the bare name, or the code of the error."""
    k, n = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    forms = [F.concat(n, F.lit(".csv")), F.concat(F.lit("x/y\\"), n, F.lit(".CSV")), F.concat(F.lit("/"), n, F.lit(".csv ")), F.concat(n, F.lit(".txt")), F.lit(".csv"), F.lit(" "), F.concat(n, F.lit(".csv/")), F.concat(n, F.lit(".Csv"))]
    rows = _t(spark, sf_dir, "orders").select(k, F.get(F.array(*forms), (k % 8).cast("int")).alias("name"), (k * 7919 % 30_000_000).alias("size"))
    return rows.withColumn("outcome", edge_csv.upload_outcome(F.col("name"), F.col("size")))


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN 'nrzlDefault' ELSE 'CONFIG_NOT_FOUND' END AS answer, CASE WHEN o_orderkey % 4 < 2 THEN 200 ELSE 404 END AS status,
'UP' AS health, CASE WHEN o_orderkey % 4 < 2 THEN o_orderkey || '{report.SUFFIX}' END AS file, CASE WHEN o_orderkey % 4 < 2 THEN '1/2' END AS dedup
  FROM orders""")
def service_answers(spark, sf_dir):
    """A request for each order's file, its profile's key as it stands, padded, blank or unknown: the rule that it leads to
    or the error with its status, the report's name and the tolerance shown in it."""
    k = F.col("o_orderkey")
    key = F.get(F.array(*[F.lit(x) for x in (_PROFILE.key, f" {_PROFILE.key} ", "  ", "x")]), (k % 4).cast("int"))
    asked = _t(spark, sf_dir, "orders").select("o_orderkey", F.trim(key).alias("config_key"), F.concat(k.cast("string"), F.lit(".csv")).alias("name"))
    found = asked.join(F.broadcast(config.remote_profiles(spark)).drop("name"), "config_key", "left")  # as large as its configuration
    hit, error = F.col("rule_key").isNotNull(), CaptureError("CONFIG_NOT_FOUND")
    return found.select(
        "o_orderkey", F.coalesce("rule_key", F.lit(error.code)).alias("answer"), F.when(hit, 200).otherwise(error.status).alias("status"), F.lit(captures.health(spark)["status"]).alias("health"),
        F.when(hit, report.download_name_of(F.col("name"))).alias("file"), F.when(hit, _R.dedup_fraction).alias("dedup"),
    )
