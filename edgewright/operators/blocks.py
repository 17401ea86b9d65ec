"""Windows over captures of any length, block by block.

A block is so many edges in a row; it is what one task sorts. A window over a capture is made of three parts: the window
within a block, a summary of each block (one row), and what the blocks before or behind hand on, which a window over the
summaries finds. ``edges`` has capture_id, edge_idx and edge_block; edge_idx need not be dense, a block may be missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Edges of a block: a few MB, and enough of them that a capture has few summaries.
BLOCK_EDGES = 1 << 18


def blocked(edges: DataFrame, order: str = "edge_idx") -> DataFrame:
    """``edges`` with their block, if they have none yet."""
    return edges if "edge_block" in edges.columns else edges.withColumn("edge_block", F.expr(f"CAST({order} AS BIGINT) div {BLOCK_EDGES}"))


def within(*order: str | Column):
    """The window of one block."""
    return Window.partitionBy("capture_id", "edge_block").orderBy(*(order or ("edge_idx",)))


def along():
    """The window over the blocks of a capture."""
    return Window.partitionBy("capture_id").orderBy("edge_block")


def with_summary(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """``rows`` with the columns of their block's summary (one row a block); null captures meet like others."""
    s = summary.withColumnsRenamed({"capture_id": "_c", "edge_block": "_b"})
    same = F.col("capture_id").eqNullSafe(F.col("_c")) & F.col("edge_block").eqNullSafe(F.col("_b"))
    return rows.join(s, same, "left").drop("_c", "_b")


def ends_of(edges: DataFrame, columns: tuple[str, ...], **ends) -> DataFrame:
    """The columns of each block's edge that an aggregate (``F.min_by``, ``F.max_by``) picks, as one struct a block; they
    are aggregated one by one, as buffers of plain values need no sort."""
    rows = edges.groupBy("capture_id", "edge_block").agg(*[pick(c, "edge_idx").alias(f"{name}{k}") for name, pick in ends.items() for k, c in enumerate(columns)])
    return rows.select("capture_id", "edge_block", *[F.struct(*[F.col(f"{name}{k}").alias(c) for k, c in enumerate(columns)]).alias(name) for name in ends])


def following(edges: DataFrame, *columns: str) -> DataFrame:
    """``edges`` with _next, a struct of the columns of the edge behind it, null for a capture's last edge."""
    first = ends_of(edges, columns, _first=F.min_by)
    rows = with_summary(edges, first.select("capture_id", "edge_block", F.lead("_first").over(along()).alias("_after")))
    return rows.withColumn("_next", F.coalesce(F.lead(F.struct(*columns)).over(within()), F.col("_after"))).drop("_after")


def preceding(edges: DataFrame, *columns: str) -> DataFrame:
    """``edges`` with _previous, a struct of the columns of the edge ahead of it, null for a capture's first edge."""
    last = ends_of(edges, columns, _last=F.max_by)
    rows = with_summary(edges, last.select("capture_id", "edge_block", F.lag("_last").over(along()).alias("_before")))
    return rows.withColumn("_previous", F.coalesce(F.lag(F.struct(*columns)).over(within()), F.col("_before"))).drop("_before")


def counted(edges: DataFrame, column: str, upto: str, total: str | None = None) -> DataFrame:
    """``edges`` with the sum of a column up to and with each edge, and over its capture."""
    sums = edges.groupBy("capture_id", "edge_block").agg(F.sum(column).alias("_sum"))
    zero = F.lit(0)
    carried = [F.coalesce(F.sum("_sum").over(along().rowsBetween(Window.unboundedPreceding, -1)), zero).alias("_carried")]
    carried += [F.sum("_sum").over(Window.partitionBy("capture_id")).alias(total)] if total else []
    rows = with_summary(edges, sums.select("capture_id", "edge_block", *carried))
    here = F.sum(column).over(within().rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(upto, F.coalesce(here, zero) + F.col("_carried")).drop("_carried")


def with_halo(edges: DataFrame, reach: int) -> DataFrame:
    """``edges`` and, for each block, copies of the ``reach`` edges behind it (halo is true), wherever they lie."""
    heads = edges.withColumn("_row", F.row_number().over(within())).where(F.col("_row") <= reach)
    ahead = Window.partitionBy("capture_id").orderBy("edge_idx").rowsBetween(0, reach - 1)
    lists = heads.withColumn("_list", F.collect_list(F.struct(*edges.columns)).over(ahead)).where("_row = 1")
    halo = lists.select("capture_id", "edge_block", F.lead("_list").over(along()).alias("_list"))
    halo = halo.select(F.col("edge_block").alias("_b"), F.inline("_list")).withColumn("edge_block", F.col("_b")).drop("_b")
    return edges.withColumn("halo", F.lit(False)).unionByName(halo.withColumn("halo", F.lit(True)))


def placed(probes: DataFrame, marks: DataFrame, probe_t: str, t: str, strict: bool) -> DataFrame:
    """``probes`` with the block of marks that holds the last one at or before (``strict``: before) their time; the
    first block without such a mark. Times do not fall along edge_idx. Of the marks one row a capture travels, with the
    time that each of its blocks begins at."""
    starts = marks.groupBy("capture_id", "edge_block").agg(F.min(t).alias("_t")).groupBy("capture_id")
    starts = starts.agg(F.sort_array(F.collect_list(F.struct("_t", "edge_block"))).alias("_starts")).withColumnRenamed("capture_id", "_c")
    rows = probes.join(starts, F.col("capture_id").eqNullSafe(F.col("_c")), "left")
    before = F.filter("_starts", lambda s: (s["_t"] < F.col(probe_t)) if strict else (s["_t"] <= F.col(probe_t)))
    at = F.greatest(F.size(before) - 1, F.lit(0))
    block = F.when(F.size("_starts") == 1, F.col("_starts")[0]["edge_block"]).otherwise(F.get(F.col("_starts"), at)["edge_block"])
    return rows.withColumn("edge_block", block).drop("_starts", "_c")
