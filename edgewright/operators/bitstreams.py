"""Frames in streams of sampled bits: the older way, without a fit of the bit period.

A stream is one phase of one segment: capture_id, segment, phase_us, bits (a string of 0 and 1), first_t (time of
its first sample), period_us, and the segment's start_t, end_t, left_known and right_known where they are needed.
Streams without a bit have no marker, streams that repeat give their frames each time (``deduplicated`` leaves one), null
bits give no frame, empty tables give empty ones.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import UNKNOWN_ACTION, UNKNOWN_CHANNEL, Profile
from ..functions.bits import text_to_bytes
from ..storage import cut
from .decode import failure_reasons, with_commands

#: Texts of diagnostics (fixed values).
NO_START = "未找到识别开头"
EDGE_UNMATCHED, HEAD_PIECE, TAIL_PIECE = "文件边界缺少完整活动边界且未找到识别开头", "文件开头残片", "文件结尾残片"


def framed(streams: DataFrame, profile: Profile) -> DataFrame:
    """One row for each marker that begins a frame: start_bit, bits, bytes, start_t, end_t, complete, reasons, valid,
    channel, action. A whole frame is passed over before the next search; a cut one ends its stream."""
    r = profile.rules
    marker, size = "".join(map(str, r.marker_bits)), r.prelude_bits + r.frame_bits
    last = F.length("bits") - len(marker)
    places = F.filter(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(F.col("bits"), i + 1, F.lit(len(marker))) == marker)
    begin = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("found"))
    step = lambda a, i: F.when(i >= a["next"], F.struct((i + size).alias("next"), F.array_append(a["found"], i).alias("found"))).otherwise(a)
    rows = streams.withColumn("start_bit", F.explode(F.aggregate(places, begin, step)["found"]))
    rows = rows.withColumn("bits", F.substring(F.col("bits"), F.col("start_bit") + 1, F.lit(size))).withColumn("_all", text_to_bytes(F.col("bits")))
    rows = rows.withColumn("bytes", F.slice("_all", F.lit(len(r.marker) - len(r.header) + 1), F.greatest(F.size("_all"), F.lit(1))))
    rows = with_commands(rows, r).withColumn("reasons", failure_reasons(F.col("bytes"), F.col("command_known"), profile, core=True))
    start = F.col("first_t") + F.col("start_bit") * F.col("period_us") / 1e6
    rows = rows.withColumns({"complete": F.size("bytes") >= r.frame_bytes, "valid": F.size("reasons") == 0, "start_t": start})
    end = F.least(F.col("start_t") + F.length("bits") * F.col("period_us") / 1e6, F.col("end_t").cast("double"))
    return rows.withColumn("end_t", end).withColumn("bytes", F.col("_all")).drop("_all", "command_known")


def unmatched(streams: DataFrame) -> DataFrame:
    """A whole stream as one invalid frame, for segments in which no marker was found."""
    return streams.select(
        "capture_id", "segment", "phase_us", "bits", text_to_bytes(F.col("bits")).alias("bytes"),
        F.when(F.col("bits") == "", F.col("start_t")).otherwise(F.col("first_t")).cast("double").alias("start_t"),
        F.col("end_t").cast("double").alias("end_t"), F.lit(-1).alias("start_bit"), F.lit(False).alias("valid"), F.array(F.lit(NO_START)).alias("reasons"),
        F.lit(UNKNOWN_CHANNEL).alias("channel"), F.lit(UNKNOWN_ACTION).alias("action"),
    )


def boundary_fragments(segments: DataFrame, frames: DataFrame) -> DataFrame:
    """capture_id, segment, start_t, end_t, reason: what lies before the first frame (from cover_start) of a segment
    that the file's beginning cuts, and behind the last one (to cover_end) of a segment that its end cuts."""
    found = frames.groupBy("capture_id", "segment").agg(F.min("cover_start").alias("a"), F.max_by("cover_end", "cover_start").alias("z"))
    s = segments.where("NOT (left_known AND right_known)").join(found, ["capture_id", "segment"], "left")
    part = lambda a, z, reason: F.struct(a.cast("double").alias("start_t"), z.cast("double").alias("end_t"), F.lit(reason).alias("reason"))
    none = F.col("a").isNull()
    pieces = F.array_compact(F.array(
        F.when(none, part(F.col("start_t"), F.col("end_t"), EDGE_UNMATCHED)),
        F.when(~none & ~F.col("left_known") & (F.col("start_t") < F.col("a")), part(F.col("start_t"), F.col("a"), HEAD_PIECE)),
        F.when(~none & ~F.col("right_known") & (F.col("z") < F.col("end_t")), part(F.col("z"), F.col("end_t"), TAIL_PIECE)),
    ))
    return s.select("capture_id", "segment", F.inline(pieces))


def deduplicated(frames: DataFrame, tolerance_us: float) -> DataFrame:
    """One frame for each place of a segment, numbered in each capture by start and segment.

    Frames are duplicates within the tolerance, or at neighbouring bits and within one period; valid ones, whole ones,
    early ones and small phases are preferred. Frames further apart than both bounds cannot meet, so each island is
    settled alone. Where all of an island's frames are duplicates of each other, the preferred one is what the sequential
    rule gives, and a window finds it; other islands, rare and small, run the rule itself. What the windows leave is
    written first, so a job runs when this is called."""
    order = Window.partitionBy("capture_id", "segment").orderBy("start_t", "phase_us")
    everywhere = (Window.unboundedPreceding, Window.unboundedFollowing)
    reach = F.greatest(F.lit(tolerance_us), F.max("period_us").over(order.rowsBetween(*everywhere))) / 1e6
    new = F.coalesce(F.col("start_t") - F.lag("start_t").over(order) > F.col("_reach"), F.lit(True)).cast("int")
    rows = frames.withColumn("_reach", reach).withColumn("_new", new)
    rows = rows.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_reach", "_new")
    valid, complete = (F.coalesce(F.col(c), F.lit(False)).desc() for c in ("valid", "complete"))
    best = Window.partitionBy("capture_id", "segment", "_island").orderBy(valid, complete, "start_t", "phase_us")
    most, least = (lambda c, f=f: f(c).over(best.rowsBetween(*everywhere)) for f in (F.max, F.min))
    span = most("start_t") - least("start_t")
    near = (least("start_bit") >= 0) & (most("start_bit") - least("start_bit") <= 1) & (span <= least("period_us") / 1e6)
    rows = rows.withColumns({"_simple": F.coalesce((span <= tolerance_us / 1e6) | near, F.lit(False)), "_best": F.row_number().over(best)})
    rows = cut(rows.where("NOT _simple OR _best = 1"), "islands")
    columns = frames.columns

    def rule(key, table):
        kept = []
        for r in sorted(table.to_pylist(), key=lambda r: (r["start_t"], r["phase_us"])):
            for at, k in enumerate(kept):
                apart = abs(k["start_t"] - r["start_t"])
                near = min(k["start_bit"], r["start_bit"]) >= 0 and abs(k["start_bit"] - r["start_bit"]) <= 1 and apart <= max(k["period_us"], r["period_us"]) / 1e6
                if near or apart <= tolerance_us / 1e6:
                    wish = lambda x: (not x["valid"], not x["complete"], x["start_t"], x["phase_us"])
                    if wish(r) < wish(k):
                        kept[at] = r
                    break
            else:
                kept.append(r)
        return pa.Table.from_pylist(kept, schema=table.schema).select(columns)

    hard = rows.where("NOT _simple").groupBy("capture_id", "segment", "_island").applyInArrow(rule, frames.schema)
    stay = rows.where("_simple").select(columns).unionByName(hard)
    return stay.withColumn("frame_no", F.row_number().over(Window.partitionBy("capture_id").orderBy("start_t", "segment")))
