"""A Merkle manifest of a dataset: a tree for each source, and a tree of their roots.

Levels are built bottom up: every 16 consecutive nodes of a level become a row of the next one, which keeps its children
in a list, and each level is written. Proofs are pushed top down: a level joins its rows to what their parents inherited,
and every child puts its own siblings in front. Only the rows above the leaves are ever stored with a proof.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, drop_table, shared_dir, table
from .numbering import positions

FAN_OUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """A value so that fields put in a row cannot be cut otherwise: its length in bytes, a colon, itself; null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return digest(F.concat(*map(field, values)))


@dataclass
class Tree:
    """``levels``: from the leaves up, tables (key, run, n, kids, hash), a row for each 16 nodes of a group, n being
    how many nodes the group has there. ``tops``: (key, level, hash), the one node that is left of each group."""

    levels: list[DataFrame]
    tops: DataFrame


@dataclass
class Manifest:
    """``lower``: the trees of the sources over their rows; ``upper``: the tree over the sources; all in ``folder``."""

    folder: str
    lower: Tree
    upper: Tree

    def root(self) -> str | None:
        """The digest of the whole dataset; None for an empty one."""
        row = self.upper.tops.select("hash").first()
        return row and row[0]


def grown(nodes: DataFrame, folder: str, name: str) -> Tree:
    """The trees over nodes (key, pos, n, hash, ...). A group of one node is its own top. Levels: as many as the largest
    group needs, each a sixteenth of the one below."""
    more = [c for c in nodes.columns if c not in ("key", "pos", "n", "hash")]
    largest, levels, tops = nodes.agg(F.max("n")).first()[0] or 1, [], []
    while True:
        kids = F.sort_array(F.collect_list(F.struct("pos", "hash", *more)))
        runs = nodes.groupBy("key", F.expr(f"pos div {FAN_OUT}").alias("run"), "n").agg(kids.alias("kids"))
        both = digest(F.array_join("kids.hash", ""))
        runs = cut(runs.withColumn("hash", F.when(F.col("n") > 1, both).otherwise(F.col("kids")[0]["hash"])), f"{name}_{len(levels)}", folder)
        levels.append(runs)
        nodes = runs.select("key", F.col("run").alias("pos"), F.expr(f"(n + {FAN_OUT - 1}) div {FAN_OUT}").alias("n"), "hash")
        tops.append(nodes.where("n = 1").select("key", F.lit(len(levels)).alias("level"), "hash"))
        nodes, more, largest = nodes.where("n > 1"), [], -(-largest // FAN_OUT)
        if largest <= 1:
            break
    found = tops[0]
    for t in tops[1:]:
        found = found.unionByName(t)
    return Tree(levels, cut(found, f"{name}_tops", folder))


def build(
    docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS, claim: Column | None = None, folder: str | None = None,
) -> Manifest:
    """The manifest of ``docs``, a leaf for each row: the digest of ``fields``. Rows of a group ascend by id, a null one
    first, equal ids by their leaf's digest; groups ascend by their bytes, null first. A null value differs from an empty
    text. Repeated rows are leaves of their own, an empty table has no root, other columns are not read.

    claim: a digest that is kept with each leaf, to be proved instead of it. folder: where the levels are kept for
    good; otherwise they lie with the other intermediate tables.

    Skew: rows are numbered by ranges over all tasks, and a run has 16 rows whatever the size of its group.
    """
    folder = folder or shared_dir(docs.sparkSession)
    key = F.coalesce(F.concat(F.lit("+"), F.col(group_col).cast("string")), F.lit(""))
    leaves = docs.select(
        key.alias("key"), F.col(id_col).alias("doc_id"), leaf([F.col(c) for c in fields]).alias("hash"),
        (F.lit(None) if claim is None else claim).cast("string").alias("claim"), F.monotonically_increasing_id().alias("_row"),
    )
    leaves = cut(leaves, "leaves")
    lower = grown(positions(leaves, "key", ["doc_id", "hash", "_row"], "placed").drop("_row"), folder, "lower")
    drop_table(leaves)
    groups = lower.tops.select(F.lit("all").alias("key"), F.col("key").alias("group"), "hash", "level")
    return Manifest(folder, lower, grown(positions(groups, "key", ["group"], "groups"), folder, "upper"))


def pushed(tree: Tree, inherited: DataFrame) -> DataFrame:
    """Every node at the bottom of ``tree`` with its path, and the columns that its group's top has in ``inherited``
    (key, level, path, ...). A path is a list of steps upwards, each the digests left and right of one's own."""
    carried = [c for c in inherited.columns if c not in ("key", "level", "path")]
    above = None
    for k in reversed(range(len(tree.levels))):
        parents = inherited.where(F.col("level") == k + 1).select("key", F.lit(0).cast("long").alias("run"), "path", *carried)
        parents = parents if above is None else parents.unionByName(above.select("key", F.col("pos").alias("run"), "path", *carried))
        rows = tree.levels[k].drop("hash").join(parents, ["key", "run"])
        rows = rows.select("key", "n", "path", *carried, F.col("kids.hash").alias("_all"), F.posexplode("kids").alias("_i", "_kid"))
        step = F.struct(F.array_join(F.slice("_all", F.lit(1), F.col("_i")), "").alias("l"), F.array_join(F.slice("_all", F.col("_i") + 2, F.lit(FAN_OUT)), "").alias("r"))
        path = F.when(F.col("n") > 1, F.concat(F.array(step), F.col("path"))).otherwise(F.col("path"))
        above = rows.select("key", path.alias("path"), *carried, "_kid.*")
        if k:
            above = cut(above, f"paths_{k}")
    return above


def proofs(manifest: Manifest) -> DataFrame:
    """One row for each leaf: key, doc_id, leaf, claim, subroot, root, path (steps l and r up to the root)."""
    none = F.array().cast("array<struct<l:string,r:string>>")
    tops = pushed(manifest.upper, manifest.upper.tops.select("key", "level", none.alias("path"), F.col("hash").alias("root")))
    tops = cut(tops.select(F.col("group").alias("key"), "level", "path", F.col("hash").alias("subroot"), "root"), "subroots")
    return pushed(manifest.lower, tops).select("key", "doc_id", F.col("hash").alias("leaf"), "claim", "subroot", "root", "path")


def siblings(path: Column) -> Column:
    """All digests of a path, from the leaf up and from left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), "")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's digest comes to along a path."""
    return F.aggregate(path, start, lambda h, s: digest(F.concat(s["l"], h, s["r"])))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's proof, folded from a tampered leaf where the id's crc32 divides by 5."""
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tampered = F.when(hit, leaf([ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in FIELDS]))
    rows = proofs(build(docs, claim=tampered))
    rows = rows.select("doc_id", "leaf", "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"), folded(F.coalesce("claim", "leaf"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Levels of a tree in the SQL: enough for 16 to that power rows of a source.
_SQL_LEVELS = 6


def _oracle() -> str:
    fields = lambda text: "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    octets = "list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)"
    step = "list_reduce([xor(a, b)] || range(8), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    crc = f"list_reduce([4294967295] || {octets}, lambda a, b: {step})"
    parts = [
        f"WITH d AS (SELECT doc_id, source, {fields('text')} AS leaf, CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN {fields(low)} END AS claim FROM documents)",
        "a0 AS (SELECT coalesce('+' || source, '') AS k, doc_id, leaf, claim, leaf AS h, count(*) OVER (PARTITION BY source) AS n, "
        "row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d)",
    ]

    def tree(a: str) -> None:
        for i in range(_SQL_LEVELS):
            parts.append(f"{a}r{i} AS (SELECT k, pos // 16 AS run, n, list(h ORDER BY pos) AS kids FROM {a}{i} WHERE n > 1 GROUP BY ALL)")
            parts.append(f"{a}{i + 1} AS (SELECT k, run AS pos, sha256(array_to_string(kids, '')) AS h, (n + 15) // 16 AS n FROM {a}r{i} UNION ALL SELECT k, pos, h, n FROM {a}{i} WHERE n = 1)")

    def proved(a: str, to: str, start: str, rest: str) -> None:
        """Each bottom node of tree ``a`` with the steps ``l0``, ``r0``, ... along its way."""
        steps, joins = [], []
        for i in range(_SQL_LEVELS):
            at = f"(b.pos // {16**i}) % 16"
            steps.append(f"array_to_string({a}r{i}.kids[1:{at}], '') AS l{i}, array_to_string({a}r{i}.kids[{at} + 2:], '') AS r{i}")
            joins.append(f"LEFT JOIN {a}r{i} ON {a}r{i}.k = b.k AND {a}r{i}.run = b.pos // {16 ** (i + 1)}")
        parts.append(f"{to}0 AS (SELECT b.k, {rest}, {start} AS f, {', '.join(steps)} FROM {a}0 b {' '.join(joins)})")

    tree("a")
    parts.append(f"u0 AS (SELECT 'all' AS k, k AS g, row_number() OVER (ORDER BY k) - 1 AS pos, h, count(*) OVER () AS n FROM a{_SQL_LEVELS})")
    tree("u")
    proved("u", "pu", "h", "g, h")
    proved("a", "pa", "coalesce(claim, leaf)", "doc_id, leaf")
    proof = lambda t: " || ".join(f"coalesce({t}.l{i} || {t}.r{i}, '')" for i in range(_SQL_LEVELS))
    above = ", ".join(f"pu0.l{i} AS ul{i}, pu0.r{i} AS ur{i}" for i in range(_SQL_LEVELS))
    parts.append(f"f0 AS (SELECT pa0.*, pu0.h AS subroot, sha256({proof('pa0')} || {proof('pu0')}) AS proof_sha256, {above} FROM pa0 JOIN pu0 ON pa0.k = pu0.g)")
    steps = [*((f"l{i}", f"r{i}") for i in range(_SQL_LEVELS)), *((f"ul{i}", f"ur{i}") for i in range(_SQL_LEVELS))]
    for i, (left, right) in enumerate(steps):
        parts.append(f"f{i + 1} AS (SELECT * REPLACE (CASE WHEN {left} IS NULL THEN f ELSE sha256({left} || f || {right}) END AS f) FROM f{i})")
    root = f"(SELECT h FROM u{_SQL_LEVELS})"
    return ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, {root} AS root, proof_sha256, f AS folded_root, f = {root} AS verified FROM f{len(steps)}"


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
ORACLE_SQL = {"op12_merkle_manifest": _oracle()}
