"""Exact deduplication by progressive refinement (native DataFrame operations only).

Texts are compared after each run of ASCII white space became one space. Candidates are refined in three
steps: equal length, then equal prefix hash, then equal full hash; a row leaves as soon as it is alone. What
travels between the steps is a narrow table (id, length, prefix hash, full hash), never the text. The full hash is
made in the scan that reads the text anyway, because every row returns it; it is compared only in groups that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, text_of

PREFIX_CHARS = 256


def normalised(text: Column) -> Column:
    """Each run of ``[\\x20\\x09-\\x0D]`` as one space; the pattern skips the runs that already are one space."""
    return F.regexp_replace(text, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty. Of equal texts the row with the smallest id stays; a null id counts as the
    largest. Rows repeated with the same id and text are all counted and returned, and one of them is kept.
    Other columns of ``docs`` are not looked at; an empty table gives an empty result. Long texts are hashed
    where they lie.

    Skew: every grouping has a map-side count, and is written before it is joined. Both sides of each join are then
    sorted straight from a shuffle, the form in which adaptive execution splits a hot length, prefix or text.
    """
    text = normalised(text_of(text_col))
    scanned = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t")).select(
        "doc_id",
        F.length("_t").alias("n_len"),
        F.xxhash64(F.substring("_t", 1, PREFIX_CHARS)).alias("prefix"),
        F.sha2(F.col("_t").cast("binary"), 256).alias("text_sha256"),
    )
    rows = cut(scanned.groupBy("doc_id", "n_len", "prefix", "text_sha256").agg(F.count("*").alias("copies")), "hashes")

    many = F.sum("copies") > 1
    left = rows
    for keys, name in ((["n_len"], "length"), (["n_len", "prefix"], "prefix")):
        more = cut(left.groupBy(*keys).agg(many.alias("more")).where("more").drop("more"), f"more_{name}")
        left = cut(left.join(more, keys, "left_semi"), f"same_{name}")
    groups = left.groupBy("n_len", "prefix", "text_sha256").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    groups = cut(groups.where("group_size > 1").withColumn("found", F.lit(True)), "groups")
    found = F.coalesce("found", F.lit(False))
    out = rows.join(groups, ["n_len", "prefix", "text_sha256"], "left").select(
        "doc_id",
        F.when(found, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.when(found, F.col("group_size")).otherwise(F.col("copies")).cast("long").alias("group_size"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
        "text_sha256",
    )
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rows repeated with one id and text stay once.

    A null id is an id like others that counts as the largest, a null text is empty, an empty table stays empty; the
    columns may have any names, since what is added is prefixed by what none of them begins with. The rows that go are
    told by a narrow table; texts are only sent to other tasks if that table is too large for each task to have, and
    those of rows that repeat in full."""
    own = "_"
    while any(c.startswith(own) for c in docs.columns):
        own += "_"

    def place(doc_id: Column, sha: Column) -> Column:
        return F.sha2(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), sha), 256)

    found = exact_dedup(docs, id_col, text_col).groupBy(place(F.col("doc_id"), F.col("text_sha256")).alias(own))
    found = cut(found.agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "places")
    gone, many = found.where("NOT kept").select(own), found.where("kept AND n > 1").select(own)
    placed = docs.withColumn(own, place(F.col(id_col), F.sha2(normalised(text_of(text_col)).cast("binary"), 256)))
    once = placed.join(gone.unionByName(many), own, "left_anti")
    return once.unionByName(placed.join(many, own, "left_semi").dropDuplicates([own])).select(*docs.columns)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op9_exact_dedup": op9_exact_dedup}
ORACLE_SQL = {
    "op9_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept,
       sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t"""
}
