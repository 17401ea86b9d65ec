"""Token ids in a content-addressed store.

Each document's ids are cut where a rolling hash over the last ids says so, so equal passages give equal chunks
wherever they stand. A chunk is addressed by the digest of its ids and stored once, in the row of the document
that was read first with it; every document has a recipe, the list of its chunk addresses, and the root of the Merkle
tree over them. The files lie in ascending doc_id order, part by part. A manifest has for each part the root of the tree
over its documents, in order, and their number. Reading checks each stored chunk against its address, each document
against its root, each part against the manifest, and that no chunk of a recipe is lost.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, shared_dir, table
from .tokens import PA, column_encoder, map_rows

VOCABULARY, END_ID = "word_bpe_49k.json", 2
#: Ids under the rolling hash; bits of it that must be zero at a cut; the smallest and largest chunk.
WINDOW, CUT_BITS, LEAST, MOST = 16, 10, 128, 8192
_MIX, _BASE = np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream; they depend on the ids alone."""
    n = len(ids)
    h = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
    h ^= h >> np.uint64(29)
    power, span = _BASE, 1
    while span < WINDOW:  # the hash over 2 * span ids from two over span ids
        older = np.zeros_like(h)
        older[span:] = h[: n - span] if n > span else 0
        h = h + older * np.uint64(power)
        power, span = power * power % 2**64, 2 * span
    ends, last = [], 0
    for e in (np.flatnonzero((h >> np.uint64(64 - CUT_BITS)) == 0) + 1).tolist() + [n]:
        while e - last > MOST:
            last += MOST
            ends.append(last)
        if e - last >= LEAST or e == n > last:
            ends.append(e)
            last = e
    return ends


def address(ids: bytes) -> bytes:
    return hashlib.blake2b(ids, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of the binary tree over the leaves; an odd one at the end moves up as it is."""
    level = leaves or [address(b"")]
    while len(level) > 1:
        level = [address(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def crc_of_both(left: int, right: int, n_right: int) -> int:
    """crc32 of two strings in a row from theirs: crc32 is affine, so zeros stand in for the right one."""
    zeros = bytes(n_right)
    return zlib.crc32(zeros, left) ^ zlib.crc32(zeros) ^ right


def encoded(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int) -> DataFrame:
    """doc_id, row (unique), n_tokens, chunks (addresses), lens, again (positions of chunks that repeat an earlier one of
    the document), blob (all ids as 16 or 32 bits, zstandard)."""

    def start():
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        rows = iter(range(TaskContext.get().partitionId() << 33, 1 << 63))

        def one(doc_id, ids):
            ids = np.append(ids, np.array([end_id], "<u4"))
            ends = cut_points(ids)
            raw, begins, seen = ids.tobytes(), [0, *ends[:-1]], set()
            chunks = [address(raw[4 * a : 4 * b]) for a, b in zip(begins, ends, strict=True)]
            again = [k for k, c in enumerate(chunks) if c in seen or seen.add(c)]
            yield doc_id, next(rows), len(ids), chunks, [b - a for a, b in zip(begins, ends, strict=True)], again, packed(ids, pack)

        return one

    def values(batch):
        return zip(batch.column(0).to_pylist(), column_encoder(path)(batch.column(1)), strict=True)

    columns = {"doc_id": "long", "row": "long", "n_tokens": "long", "chunks": "array<binary>", "lens": "array<int>", "again": "array<int>", "blob": "binary"}
    return map_rows(docs.select(F.col(id_col), F.col(text_col)), start, columns, 500, values)


def packed(ids: np.ndarray, pack) -> bytes:
    wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
    return (b"4" if wide else b"2") + pack(ids.astype("<u4" if wide else "<u2").tobytes())


def unpacked(blob: bytes, unpack) -> np.ndarray:
    return np.frombuffer(unpack(blob[1:]), "<u4" if blob[:1] == b"4" else "<u2").astype("<u4")


STORED = {"doc_id": "long", "row": "long", "n_tokens": "long", "root": "binary", "chunks": "array<binary>", "lens": "array<int>", "elsewhere": "array<int>", "blob": "binary"}


def write_store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encode every text and write the store below ``path``: ``documents`` (recipe, root and the chunks that it is
    the first to hold), ``index`` (doc_id, row, start, n_tokens, root), both in ascending doc_id order, and
    ``manifest`` (part, n_docs, root).

    A null text counts as empty: only the end id. A null id sorts first. Rows with one id each get a document.
    Other columns are not read; an empty table gives an empty store. A chunk that very many documents share
    costs each of them one address; its owners are written before they are joined, so its rows can be split.
    """
    spark = docs.sparkSession
    staged = cut(encoded(docs, id_col, text_col, tokenizer or public_tokenizers.path(VOCABULARY), end_id), "encoded")
    first = F.filter(F.arrays_zip(F.sequence(F.lit(0), F.size("chunks") - 1).alias("k"), F.col("chunks").alias("chunk")), lambda x: ~F.array_contains("again", x["k"]))
    entries = staged.select("doc_id", "row", F.explode(first).alias("x")).select("doc_id", "row", "x.k", "x.chunk")
    owners = cut(entries.groupBy("chunk").agg(F.min("row").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n"), "owners")
    elsewhere = entries.join(owners, "chunk").where("row <> owner").groupBy("doc_id", "row").agg(F.sort_array(F.collect_list("k")).alias("elsewhere"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = staged.withColumn("elsewhere", F.lit(None).cast("array<int>")).unionByName(elsewhere, allowMissingColumns=True)
    ordered = both.repartitionByRange(n, "doc_id", "row").sortWithinPartitions("doc_id", "row", F.col("n_tokens").isNull())
    schema = pa.schema([(c, PA[t]) for c, t in STORED.items()])

    def write(batches):
        import zstandard

        pack, unpack, doc, out = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress, None, []

        def finish(x):
            there = {*(x["elsewhere"] or ()), *x.pop("again")}
            blob = x["blob"]
            if there:
                ids, at = unpacked(blob, unpack), 0
                own = []
                for k, m in enumerate(x["lens"]):
                    if k not in there:
                        own.append(ids[at : at + m])
                    at += m
                blob = packed(np.concatenate(own) if own else ids[:0], pack)
            return x | {"root": merkle_root(x["chunks"]), "elsewhere": sorted(there), "blob": blob}

        for b in batches:
            for at in range(0, b.num_rows, 256):
                for x in b.slice(at, 256).to_pylist():
                    if x["n_tokens"] is None:  # what is stored elsewhere follows its document
                        doc["elsewhere"] = x["elsewhere"]
                        continue
                    if doc is not None:
                        out.append(finish(doc))
                    doc = x
                if len(out) >= 500:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
        if doc is not None:
            out.append(finish(doc))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    parts = ordered.mapInArrow(write, ", ".join(f"{c} {t}" for c, t in STORED.items()))
    parts.withColumn("part", F.spark_partition_id()).write.option("compression", "zstd").parquet(f"{path}/documents")
    part_roots(spark, path).write.parquet(f"{path}/manifest")

    stored = spark.read.parquet(f"{path}/documents").select("doc_id", "row", "part", "n_tokens", "root")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row for each part
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    index = stored.join(F.broadcast(parts), "part").withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    index.select("doc_id", "row", "part", "start", "n_tokens", "root").write.parquet(f"{path}/index")


def part_roots(spark: SparkSession, path: str) -> DataFrame:
    """part, n_docs, root: of the roots of each part's documents, in order. A part is as large as a partition."""

    def root(key, rows):
        rows = rows.sort_by([("none", "descending"), ("doc_id", "ascending"), ("row", "ascending")])
        out = [[key[0].as_py()], [rows.num_rows], [merkle_root(rows["root"].to_pylist())]]
        return pa.table([pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["part", "n_docs", "root"])

    rows = spark.read.parquet(f"{path}/documents").select("part", F.col("doc_id").isNull().alias("none"), "doc_id", "row", "root")
    return rows.groupBy("part").applyInArrow(root, "part int, n_docs long, root binary")


def verify(spark: SparkSession, path: str) -> None:
    """Compare the files with the manifest and the index; a document lost, added or changed raises ValueError."""
    manifest, now = spark.read.parquet(f"{path}/manifest"), part_roots(spark, path)
    both = manifest.alias("m").join(now.alias("n"), "part", "full").where("NOT (m.root <=> n.root AND m.n_docs <=> n.n_docs)")
    if bad := both.select("part").orderBy("part").first():
        raise ValueError(f"part {bad[0]} of the store differs from its manifest")
    index = spark.read.parquet(f"{path}/index").select("row", F.col("root").alias("want"))
    stored = spark.read.parquet(f"{path}/documents").select("row", "root")
    if bad := stored.join(index, "row", "full").where("NOT (root <=> want)").select("row").first():
        raise ValueError(f"row {bad[0]} of the store differs from its index")


def stored_chunks(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """doc_id, row, root, chunks, lens, found: for each chunk of the recipe its crc32 (with ``ids`` its ids) where
    the document's own row stores it, else null. Every stored chunk is checked against its address, every recipe
    against its root; a mismatch raises ValueError."""

    def start():
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress

        def one(doc_id, row, root, chunks, lens, elsewhere, blob):
            if merkle_root(chunks) != root:
                raise ValueError(f"document {doc_id}: the recipe differs from its root")
            there, own, at, found = set(elsewhere), unpacked(blob, unpack).tobytes(), 0, []
            for k, m in enumerate(lens):
                if k in there:
                    found.append(None)
                    continue
                x = own[at : at + 4 * m]
                at += 4 * m
                if address(x) != chunks[k]:
                    raise ValueError(f"document {doc_id}: chunk {k} differs from its address")
                found.append(x if ids else zlib.crc32(x))
            yield doc_id, row, chunks, lens, found

        return one

    rows = spark.read.parquet(f"{path}/documents").select("doc_id", "row", "root", "chunks", "lens", "elsewhere", "blob")
    columns = {"doc_id": "long", "row": "long", "chunks": "array<binary>", "lens": "array<int>", "found": "array<binary>" if ids else "array<long>"}
    return map_rows(rows, start, columns, 500)


def _content(doc_id, k: int, own, more: dict):
    """What the document's own row stores of chunk k, or another's; ValueError if no row does."""
    x = more.get(k) if own is None else own
    if x is None:
        raise ValueError(f"document {doc_id}: chunk {k} is lost")
    return x


def _fetched(own: DataFrame) -> DataFrame:
    """``own`` with column ``more``: position and content of the chunks that other documents store."""
    entries = own.select("row", F.posexplode(F.arrays_zip("chunks", "found")).alias("k", "x")).select("row", "k", "x.chunks", "x.found")
    there = entries.where("found IS NOT NULL").select("chunks", "found")
    more = entries.where("found IS NULL").drop("found").join(there, "chunks", "left")
    more = more.groupBy("row").agg(F.collect_list(F.struct("k", "found")).alias("more"))
    return own.join(more, "row", "left").withColumn("more", F.coalesce(F.map_from_entries("more"), F.create_map().cast(more_type(own))))


def more_type(own: DataFrame) -> str:
    kind = own.schema["found"].dataType.elementType
    return f"map<int,{kind.simpleString()}>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (array of int): the documents as they were encoded. A damaged store raises ValueError."""
    verify(spark, path)
    own = cut(stored_chunks(spark, path, ids=True), "chunks")
    index = spark.read.parquet(f"{path}/index").select("row", "start")

    def start():
        def one(doc_id, start, found, more):
            more = dict(more)
            yield doc_id, start, np.frombuffer(b"".join(_content(doc_id, k, x, more) for k, x in enumerate(found)), "<u4").tolist()

        return one

    rows = _fetched(own).join(index, "row").select("doc_id", "start", "found", "more")
    return map_rows(rows, start, {"doc_id": "long", "start": "long", "ids": "array<int>"}, 200)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: from the files, without moving ids. A document's crc32 is put together
    from those of its chunks, each computed where the chunk is stored."""
    verify(spark, path)
    own = cut(stored_chunks(spark, path), "chunks")
    index = spark.read.parquet(f"{path}/index").select("row", "start")

    def start():
        def one(doc_id, start, lens, found, more):
            more, crc = dict(more), 0
            for k, (m, x) in enumerate(zip(lens, found, strict=True)):
                crc = crc_of_both(crc, _content(doc_id, k, x, more), 4 * m)
            yield doc_id, start, sum(lens), crc

        return one

    rows = _fetched(own).join(index, "row").select("doc_id", "start", "lens", "found", "more")
    return map_rows(rows, start, {"doc_id": "long", "start": "long", "n_tokens": "long", "ids_crc32": "long"})


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens"
    write_store(table(spark, sf_dir, "documents"), path)
    return read_digests(spark, path)


QUERIES = {"op2_token_store": op2_token_store}
ORACLE_SQL: dict[str, str] = {}
