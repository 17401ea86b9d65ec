"""Chat formatting with cumulative-snapshot collapse.

Loggers often store a conversation again after every turn. A rolling hash over the turns gives every prefix of
every conversation a name; a conversation whose whole name is the name of a proper prefix of a longer one is such a
snapshot and goes (an anti-join), and of equal conversations one stays. What is left is rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Turns of a block: a conversation of any length is numbered and hashed block by block.
BLOCK = 1024
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"


def ordered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, block, k (from 1, in the block), role, text, t1, t2 (hashes of role and text), each turn once; written
    to a table, the only one with texts."""
    clean = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    clean = clean.withColumn("block", F.coalesce(F.expr(f"turn div {BLOCK}"), F.lit(-1 << 62)))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    once = Window.partitionBy("conv_id", "block", "turn", "role", "text").orderBy("k")
    rows = clean.withColumn("k", F.dense_rank().over(inside)).withColumn("_copy", F.row_number().over(once)).where("_copy = 1")
    hashes = F.xxhash64("role", "text").alias("t1"), F.xxhash64("text", F.lit("second"), "role").alias("t2")
    return cut(rows.select("conv_id", "block", "k", "role", "text", *hashes), "turns")


def rolling_names(rows: DataFrame) -> DataFrame:
    """conv_id, idx (from 1), h1, h2: the rolling hash of the turns up to each; no texts.

    The hash is the exclusive or of hashes of (position, turn), so blocks of a conversation can be hashed apart and
    put together; no window spans more than one block or the list of a conversation's blocks.
    """
    rows = rows.select("conv_id", "block", "k", "t1", "t2")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b"))

    def ahead(df, **columns):
        sums = df.groupBy("conv_id", "block").agg(*[f.alias(f"_{c}") for c, (f, _) in columns.items()])
        return sums.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), *[F.coalesce(over(f"_{c}").over(before), zero).alias(c) for c, (_, over) in columns.items()])

    sizes = ahead(rows, ahead=(F.count("*"), F.sum))
    rows = rows.join(sizes, same).withColumn("idx", F.col("ahead") + F.col("k")).drop("_c", "_b", "ahead")
    rows = rows.withColumns({"g1": F.xxhash64("idx", "t1"), "g2": F.xxhash64("t2", "idx")})
    marks = ahead(rows, b1=(F.bit_xor("g1"), F.bit_xor), b2=(F.bit_xor("g2"), F.bit_xor))
    upto = Window.partitionBy("conv_id", "block").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"g1": F.bit_xor("g1").over(upto), "g2": F.bit_xor("g2").over(upto)}).join(marks, same)
    return rows.select("conv_id", "idx", F.col("g1").bitwiseXOR(F.col("b1")).alias("h1"), F.col("g2").bitwiseXOR(F.col("b2")).alias("h2"))


def maximal_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that stay; rows: what ``ordered_turns`` gives."""
    names = cut(rolling_names(rows), "names")
    n_turns = names.groupBy("conv_id").agg(F.max("idx").alias("n")).select(F.col("conv_id").alias("_c"), "n")
    ends = names.join(n_turns, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    whole = ends.where("idx = n").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = ends.where("idx < n").select(F.col("idx").alias("n"), "h1", "h2").distinct()
    stay = whole.join(inner, ["n", "h1", "h2"], "left_anti")
    return stay.select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def render(turns: DataFrame) -> DataFrame:
    """One row for each maximal conversation: conv_id, n_turns, n_copies (equal conversations, itself included), chat.

    Turns are ordered by turn, then role and text; a null turn comes first, a null role or text counts as empty,
    rows that repeat a turn exactly count once. Of equal conversations the smallest id stays; a null id is an id
    like others and stays only without another. Other columns are not read; empty in, empty out. A conversation
    is one string in the end, so its turns meet in one row; nothing else gathers a group.
    """
    rows = ordered_turns(turns)
    stay = maximal_conversations(rows)
    line = F.concat(F.lit(TURN_START), "role", F.lit("\n"), "text", F.lit(TURN_END + "\n"))
    kept = rows.join(stay.select(F.col("conv_id").alias("_c")), F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi")
    chats = kept.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "k", line.alias("line")))).alias("lines"))
    chats = chats.select(F.col("conv_id").alias("_c"), F.array_join("lines.line", "").alias("chat"))
    return stay.join(chats, F.col("conv_id").eqNullSafe(F.col("_c"))).select("conv_id", "n_turns", "n_copies", "chat")


def op1_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(table(spark, sf_dir, "conversations"))


QUERIES = {"op1_chat_snapshots": op1_chat_snapshots}
ORACLE_SQL = {
    "op1_chat_snapshots": f"""
WITH t AS (
  SELECT conv_id, list('{TURN_START}' || role || chr(10) || text || '{TURN_END}' || chr(10) ORDER BY turn NULLS FIRST, role, text) AS l
  FROM (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations) GROUP BY conv_id),
w AS (SELECT l, len(l) AS n, min(conv_id) AS conv_id, count(*) AS n_copies FROM t GROUP BY l),
p AS (SELECT DISTINCT list_slice(l, 1, k) AS l FROM (SELECT l, unnest(range(1, len(l))) AS k FROM w))
SELECT conv_id, n::BIGINT AS n_turns, n_copies::BIGINT AS n_copies, array_to_string(l, '') AS chat
FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.l = w.l)"""
}
