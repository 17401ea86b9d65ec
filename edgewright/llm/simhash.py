"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint maps to the bit counts of its two-bit segments; the Manhattan distance of two such vectors never
exceeds the Hamming distance of the fingerprints. The grid range join covers the Manhattan ball: the segments lie
in GROUPS = bits + 3 groups, so within ``bits`` at least three groups have equal counts; a fingerprint goes into
one cell for each choice of three. Inside a cell the Manhattan bound comes first, then the exact distance.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, text_of
from .components import connected_components
from .tokens import map_rows

SHINGLE_WORDS, MAX_BITS, SEED = 4, 4, 42
#: Groups of segments that must agree in a cell.
AGREE = 3
#: Cells up to this size are compared pair by pair at once, larger ones by search from one fingerprint to the next.
SMALL_CELL = 8
_EVEN = np.uint64(0x5555555555555555)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text; a text without a word has 0."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    k = min(shingle_words, len(words))
    begins = [0, *[e + 1 for e in ends[: len(words) - k]]]
    h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begins, ends[k - 1 :], strict=True)], "<u8")
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def embedded(fp: np.ndarray) -> np.ndarray:
    """The counts of the 32 two-bit segments, two bits each."""
    high = fp >> np.uint64(1)
    return ((fp & high & _EVEN) << np.uint64(1)) | ((fp ^ high) & _EVEN)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of two embedded fingerprints: counts 0, 1, 2 differ by 1, 2, 1 where their codes' xor is 1, 2, 3."""
    x = a ^ b
    low, high = x & _EVEN, (x >> np.uint64(1)) & _EVEN
    return np.bitwise_count(low).astype(np.int64) + 2 * np.bitwise_count(high & ~low).astype(np.int64)


def near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    ok = manhattan(embedded(a), embedded(b)) <= bits
    if ok.any():
        ok[ok] = np.bitwise_count(np.broadcast_to(a, ok.shape)[ok] ^ np.broadcast_to(b, ok.shape)[ok]) <= bits
    return ok


def cell_masks(bits: int) -> list[np.uint64]:
    """Masks of the embedding, one for each choice of AGREE out of bits + AGREE groups of segments."""
    groups = [0] * (bits + AGREE)
    for s in range(32):
        groups[s * len(groups) // 32] |= 3 << (2 * s)
    return [np.uint64(sum(c)) for c in combinations(groups, AGREE)]


def cell_links(fp: np.ndarray, cell: np.ndarray, bits: int) -> list[np.ndarray]:
    """Links (2 x n) that connect what is linked inside each cell; ``cell`` is sorted. Inside a large cell a search
    takes everything near one fingerprint out of the rest, so a dense cell costs few steps and gives a forest."""
    out = []
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[starts, len(cell)])
    size_of = np.repeat(sizes, sizes)
    for d in range(1, SMALL_CELL):
        i = np.flatnonzero((cell[d:] == cell[:-d]) & (size_of[d:] <= SMALL_CELL)) if len(cell) > d else ()
        if not len(i):
            break
        i = i[near(fp[i], fp[i + d], bits)]
        out.append(np.stack([fp[i], fp[i + d]]))
    for s, n in zip(starts[sizes > SMALL_CELL].tolist(), sizes[sizes > SMALL_CELL].tolist(), strict=True):
        rest, queue = fp[s : s + n], []
        while len(rest):
            if queue:
                x = queue.pop()
            else:
                x, rest = rest[0], rest[1:]
            ok = near(rest, x, bits)
            if ok.any():
                got = rest[ok]
                out.append(np.stack([np.full(len(got), x), got]))
                queue.extend(got)
                rest = rest[~ok]
    return out


def fingerprint_links(prints: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) among distinct fingerprints (``fp``: long) that connect all those at ``bits`` or fewer
    differing bits: any two that near are linked or joined by a chain of such links."""
    masks = cell_masks(bits)
    schema = pa.schema([("cell", pa.int64()), ("fp", pa.int64())])

    def cells(batches):
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            e = embedded(fp)
            for n, mask in enumerate(masks):
                key = (e & mask) * _MIX + np.uint64(n)
                key = (key ^ (key >> np.uint64(31))) * _MIX
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64))], schema=schema)

    pair = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def joined(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []  # of the cell whose end has not come yet

        def links(fp, cell):
            found = cell_links(fp, cell, bits)
            if found:
                ab = np.concatenate(found, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ab[0]), pa.array(ab[1])], schema=pair)

        def closed():
            yield from links(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()

        for b in batches:
            cell, fp = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            if not len(cell):
                continue
            first = int(np.searchsorted(cell, cell[0], "right"))
            if held and held[0][1][0] == cell[0]:  # the cell goes on
                held.append((fp[:first], cell[:first]))
                cell, fp = cell[first:], fp[first:]
                if not len(cell):
                    continue
            if held:
                yield from closed()
            last = int(np.searchsorted(cell, cell[-1], "left"))
            yield from links(fp[:last], cell[:last])
            held.append((fp[last:], cell[last:]))
        if held:
            yield from closed()

    spark = prints.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = prints.mapInArrow(cells, "cell long, fp long").repartition(n, "cell").sortWithinPartitions("cell", "fp")
    return dealt.mapInArrow(joined, "a long, b long").distinct()


def components_of_rows(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, bits: int) -> DataFrame:
    """doc_id, key (a hash of the text), fp, label (the smallest fingerprint of the component), component_id."""

    def start():
        def one(doc_id, key, text):
            fp = fingerprint(text, shingle_words)
            yield doc_id, key, fp - (1 << 64) if fp >> 63 else fp

        return one

    read = docs.select(F.col(id_col), F.xxhash64(text_of(text_col)), F.col(text_col))
    rows = cut(map_rows(read, start, {"doc_id": "long", "key": "long", "fp": "long"}), "prints")
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    links = fingerprint_links(prints.select("fp"), bits)
    labels = connected_components(links)
    nodes = prints.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    nodes = cut(nodes, "nodes")  # this and the minima are written, so a hot label's join can be split
    smallest = cut(nodes.groupBy("label").agg(F.min("first_id").alias("component_id")), "smallest")
    of_print = nodes.join(smallest, "label").select("fp", "label", "component_id")
    return rows.join(of_print, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: doc_id, fp (long), component_id, the smallest id among all texts reachable by links.

    Texts without a word (null, empty) have fingerprint 0 and are linked like any other. Equal fingerprints are
    one node, so copies cost no links; no cell is capped. Null ids never give a component its id unless it has no
    other. Repeated rows get the same component. Other columns are not read; empty in, empty out.
    """
    return components_of_rows(docs, id_col, text_col, shingle_words, bits).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one document of each component, that with the smallest
    id (a null id is the largest), and of several with that id the one whose text has the smallest hash.

    Each row is judged by its own text: rows with one id and texts of different components stay or go on their own.
    Rows repeated with one id and text are one document, all or none of them stay.
    """
    found = components_of_rows(docs, id_col, text_col, shingle_words, bits)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    stays = found.groupBy("label").agg(first).select(F.col("first.doc_id").alias("_stays"), F.col("first.key").alias("_stays_key"))
    keyed = docs.withColumn("_near_key", F.xxhash64(text_of(text_col)))
    same = (F.col("_near_key") == F.col("_stays_key")) & F.col(id_col).eqNullSafe(F.col("_stays"))
    return keyed.join(stays, same, "left_semi").select(*docs.columns)


def op3_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op3_simhash_components": op3_simhash_components}
ORACLE_SQL: dict[str, str] = {}
