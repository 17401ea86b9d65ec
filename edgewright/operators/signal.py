"""Intervals, segments and pulse runs of an edge table (capture_id, edge_idx, t, level, ...).

Every operator takes the name of its time column and the idle threshold or window in that column's unit, so exact
decimals stay exact. Rows are ordered by edge_idx; equal times and repeated levels are allowed, and times do not fall.
Windows are made block by block (``blocks``), so a capture of any length is spread over many tasks. Every operator keeps
the column edge_block, and makes it where it is missing. An empty table gives an empty one; a null capture is a capture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import blocked, counted, following, placed, preceding, with_halo, within


def monotonic_violations(edges: DataFrame, t: str = "t") -> DataFrame:
    """Edges that lie before the one ahead of them, with its time (previous_t). A null time is no violation."""
    rows = preceding(blocked(edges), t).withColumn("previous_t", F.col(f"_previous.{t}"))
    return rows.drop("_previous").where(F.col(t) < F.col("previous_t"))


def intervals(edges: DataFrame, t: str = "t") -> DataFrame:
    """capture_id, edge_idx, start_t, end_t, level, edge_block: half-open [start_t, end_t) at one level; the last edge opens none."""
    rows = following(blocked(edges).select("capture_id", "edge_idx", "edge_block", F.col(t).alias("start_t"), "level"), "start_t", "level")
    return rows.select("capture_id", "edge_idx", "start_t", F.col("_next.start_t").alias("end_t"), "level", "edge_block").where("end_t IS NOT NULL")


def idle_separator(idle_level: int, threshold) -> Column:
    """Whether an interval is long enough at the idle level; the raw level counts, not the mapped bit."""
    return (F.col("level") == idle_level) & (F.col("end_t") - F.col("start_t") >= F.lit(threshold))


def segments(spans: DataFrame, idle_level: int, threshold) -> DataFrame:
    """Activity between idle separators: capture_id, segment, start_t, end_t, n_intervals, left_known, right_known.

    A side is known if a separator stands there. Segments of no length are dropped, the others numbered from 1. A long
    segment is summed up by parts, one for each block.
    """
    rows = blocked(spans).withColumn("_sep", idle_separator(idle_level, threshold).cast("int"))
    rows = counted(rows, "_sep", "_island", "_seps").where("_sep = 0")
    part = F.min("start_t").alias("start_t"), F.max("end_t").alias("end_t"), F.count("*").alias("n_intervals")
    found = rows.groupBy("capture_id", "_island", "_seps").agg(*part).where("start_t < end_t")
    number = F.row_number().over(Window.partitionBy("capture_id").orderBy("_island"))
    known = (F.col("_island") > 0).alias("left_known"), (F.col("_island") < F.col("_seps")).alias("right_known")
    return found.select("capture_id", number.alias("segment"), "start_t", "end_t", "n_intervals", *known)


def at_file_boundary(left_known: str = "left_known", right_known: str = "right_known") -> Column:
    return ~(F.col(left_known) & F.col(right_known))


def pulse_runs(edges: DataFrame, low, high, least: int = 5, most: int = 16, t: str = "t") -> DataFrame:
    """For each edge that starts ``least`` or more pulses of low to high (both inclusive) in a row: capture_id,
    edge_idx, t, pulses (``most`` at most), and points, the edges of the run as (x: pulse number, y: time since its
    first edge).

    A run ends at the first edge without such a pulse: the last edge of an island that begins behind the one before it,
    so its length is a difference of row numbers. Only edges of runs that are long enough are put into lists. A block
    sees as many edges behind it as a run can have."""
    rows = with_halo(blocked(edges).select("capture_id", "edge_idx", "edge_block", F.col(t).alias("t")), most + 1)
    one = F.coalesce((F.lead("t").over(within()) - F.col("t")).between(F.lit(low), F.lit(high)), F.lit(False))
    rows = rows.withColumns({"_one": one, "_row": F.row_number().over(within())})
    ended = F.count_if(~F.col("_one")).over(within().rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_island", F.coalesce(ended, F.lit(0)))
    island = Window.partitionBy("capture_id", "edge_block", "_island")
    rows = rows.withColumns({"_stop": F.max("_row").over(island), "_start": F.min("_row").over(island)})
    ahead = within().rowsBetween(0, most)
    rows = rows.withColumn("_times", F.collect_list(F.when(F.col("_stop") - F.col("_start") >= least, F.col("t"))).over(ahead))
    rows = rows.withColumn("pulses", F.least(F.lit(most), F.col("_stop") - F.col("_row")).cast("int")).where((F.col("pulses") >= least) & ~F.col("halo"))
    points = F.transform(F.slice("_times", F.lit(1), F.col("pulses") + 1), lambda x, i: F.struct(i.cast("double").alias("x"), (x - F.col("t")).cast("double").alias("y")))
    return rows.select("capture_id", "edge_idx", "t", "pulses", points.alias("points"), "edge_block")


def asof(probes: DataFrame, edges: DataFrame, probe_t: str = "probe_t", t: str = "t", strict: bool = False) -> DataFrame:
    """``probes`` with the last edge at or before ``probe_t`` (strictly before, with ``strict``): prev_t, prev_level,
    and the time of the edge after that one, next_t. A probe goes to the block of that edge, where both sides are sorted
    by time; there is no range join, and a hot capture is as many tasks as it has blocks."""
    e = following(blocked(edges).select("capture_id", "edge_idx", "edge_block", F.col(t).alias("_t"), "level"), "_t", "level")
    p = probes.select("capture_id", F.struct(*probes.columns).alias("_probe"), F.col(probe_t).alias("_t"), F.lit(0 if strict else 1).alias("_side"))
    p = placed(p, e, "_t", "_t", strict)
    e = e.withColumns({"_side": F.lit(1 if strict else 0), "_edge": F.struct(F.col("_t").alias("t"), "level", F.col("_next._t").alias("n"))})
    both = e.select("capture_id", "edge_block", "_t", "_side", "edge_idx", "_edge").unionByName(p, allowMissingColumns=True)
    before = within("_t", "_side", "edge_idx").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_edge", F.last("_edge", ignorenulls=True).over(before)).where("_probe IS NOT NULL")
    return found.select("_probe.*", F.col("_edge.t").alias("prev_t"), F.col("_edge.level").alias("prev_level"), F.col("_edge.n").alias("next_t"))


def nearest_edge(probes: DataFrame, edges: DataFrame, within, probe_t: str = "probe_t", t: str = "t") -> DataFrame:
    """``probes`` with the time of the nearest edge at most ``within`` away (nearest_t, else null); of two equally
    near edges the earlier one."""
    both = asof(probes, edges, probe_t, t)
    back, ahead = F.col(probe_t) - F.col("prev_t"), F.col("_ahead") - F.col(probe_t)
    first = edges.groupBy(F.col("capture_id").alias("_c")).agg(F.min(t).alias("_first"))
    both = both.join(first, F.col("capture_id").eqNullSafe(F.col("_c")), "left").withColumn("_ahead", F.when(F.col("prev_t").isNull(), F.col("_first")).otherwise(F.col("next_t")))
    best = F.when(F.col("prev_t").isNotNull() & (ahead.isNull() | (back <= ahead)), F.col("prev_t")).otherwise(F.col("_ahead"))
    near = F.abs(F.col(probe_t) - best) <= F.lit(within)
    return both.select(*probes.columns, F.when(near, best).alias("nearest_t"))


def phase_grid(fits: DataFrame, phases: int, period: str = "period") -> DataFrame:
    """Each row once for each sampling phase k * period / phases."""
    return fits.withColumn("phase_no", F.explode(F.sequence(F.lit(0), F.lit(phases - 1)))).withColumn("phase", F.col("phase_no") * F.col(period) / phases)


def sampled_levels(spans: DataFrame, segments: DataFrame, period: float, phases: int, level_col: str = "level") -> DataFrame:
    """Fixed-period sampling of every segment for every phase: capture_id, segment, phase_no, k, sample_t, level.

    Sample k of a phase lies at the start of the segment plus phase plus k periods, before the segment's end; each
    interval of the segment finds the samples that it contains by arithmetic. Intervals outside all segments have none."""
    s = segments.select("capture_id", F.col("segment").cast("long").alias("edge_idx"), "start_t", "end_t")
    s = blocked(s).withColumn("level", F.struct("edge_idx", F.col("start_t").alias("a"), F.col("end_t").alias("z")))
    rows = asof(spans.select("capture_id", "start_t", "end_t", F.col(level_col).alias("_level")), s, "start_t", "start_t")
    rows = rows.where(F.col("start_t") < F.col("prev_level.z")).withColumn("phase_no", F.explode(F.sequence(F.lit(0), F.lit(phases - 1))))
    origin = F.col("prev_level.a").cast("double") + F.col("phase_no") * (period / phases)
    low = F.ceil((F.col("start_t").cast("double") - origin) / period)
    high = F.ceil((F.col("end_t").cast("double") - origin) / period) - 1
    rows = rows.withColumns({"_low": F.greatest(low, F.lit(0)), "_high": high, "_origin": origin}).where("_low <= _high")
    rows = rows.withColumn("k", F.explode(F.sequence("_low", "_high")))
    return rows.select("capture_id", F.col("prev_level.edge_idx").cast("int").alias("segment"), "phase_no", "k", (F.col("_origin") + F.col("k") * period).alias("sample_t"), F.col("_level").alias("level"))
