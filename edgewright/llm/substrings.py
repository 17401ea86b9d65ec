"""Repeated substrings by distributed prefix doubling.

Every byte that a ``LENGTH``-byte string covers is removed if that string starts anywhere else too. A window is a
LENGTH-byte string. Doubling over all positions would move many times the input, so positions that cannot repeat, or
that are known to, leave first. A window's anchor is the GRAM-byte string in it with the least hash (the leftmost one):
equal windows have equal anchors at equal places. Consecutive windows with one anchor are a run.

1. runs are sorted by the hash of their anchor; those whose anchor is unique leave;
2. next by the hash of the run's whole text: all windows of runs that are equal here are repeated, past the threshold;
   one run of each such class goes on as a partner for others of its anchor;
3. the windows of a run are divided into PARTS by their distance to the anchor; the bytes that all windows of a part
   hold are its core, and windows whose core is unique leave;
4. doubling over the windows left: a position's rank is first the hash of n = LENGTH / 4 bytes. Spark sorts the pairs
   (rank(p), rank(p + n)), equal pairs get a new common rank and unique ones leave. The second halves of the windows left
   are ranked by such a sort too, and with n doubled Spark sorts (rank(p), rank(p + n)) again. That is past the
   threshold: what is not unique is repeated. Ranks of first and second halves are never compared, so the halves are
   sorted one after the other, the second one without what has left.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_table, table, text_of
from .tokens import PA

LENGTH, GRAM = 200, 40
#: Parts that a run's windows are divided into in step 3.
PARTS = 4

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For both bases the powers of the base and of its inverse modulo 2**64, n of them at least."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = 1 << max(16, n.bit_length())
        _POWERS.clear()
        for base in _BASES:
            both = []
            for b in (base, pow(base, -1, 1 << 64)):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                both.append(np.multiply.accumulate(p))
            _POWERS.append(tuple(both))
    return _POWERS


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def gram_hashes(b: np.ndarray, k: int, base: int = 0) -> np.ndarray:
    """A hash of b[i:i + k] for each i."""
    n = len(b)
    power, inverse = _powers(n + 1)[base]
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * inverse[: n - k + 1])


def runs_of(b: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window and anchor hash of every run of a text of ``length`` bytes or more."""
    h = gram_hashes(b, gram)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, span = length - gram + 1, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:] - 1, len(at) - 1]
    return first, last, h[at[first]]


RUNS = {"cell": "long", "f1": "long", "f2": "long", "doc_id": "long", "key": "long", "s": "int", "e": "int", "local": "boolean"}
FOUND = {"cell": "long", "doc_id": "long", "key": "long", "s": "int", "e": "int", "whole": "boolean", "partner": "boolean"}
CONTEXTS = {"run": "long", "doc_id": "long", "key": "long", "s": "int", "windows": "int", "anchor": "int", "context": "binary"}


def sizes(length: int) -> tuple[int, int]:
    """Bytes of a rank before the first and before the second sort of pairs."""
    first = -(-length // 4)
    return first, 2 * first


def _schema(columns: dict[str, str]) -> tuple[pa.Schema, str]:
    return pa.schema([(c, PA[t]) for c, t in columns.items()]), ", ".join(f"`{c}` {t}" for c, t in columns.items())


def sampled_runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """The runs of all texts (docs: doc_id, key, text). ``cell`` is the anchor's hash. A run whose text repeats
    inside its document is known to be repeated: one of each such class goes to its cell, the others (``local``)
    to cells of their own, so a text that only repeats itself makes no large cell."""
    schema, ddl = _schema(RUNS)

    def run(batches):
        from xxhash import xxh3_128_digest

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                part = batch.slice(at, 256)
                for doc_id, key, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    raw = text.encode()
                    if len(raw) < length:
                        continue
                    first, last, cell = runs_of(np.frombuffer(raw, np.uint8), length, gram)
                    f = b"".join([xxh3_128_digest(raw[s : e + length]) for s, e in zip(first.tolist(), last.tolist(), strict=True)])
                    f = np.frombuffer(f, "<i8").reshape(-1, 2)
                    order = np.lexsort((f[:, 1], f[:, 0]))
                    same = (f[order[1:]] == f[order[:-1]]).all(axis=1)
                    local = np.zeros(len(f), bool)
                    again = np.zeros(len(f), bool)
                    again[order[1:][same]] = True
                    local[order[1:][same]] = True
                    local[order[:-1][same]] = True
                    spread = mixed(np.arange(len(f), dtype=np.uint64) + np.uint64(key % (1 << 64)))
                    cell = np.where(again, spread, cell).view(np.int64)
                    n = len(f)
                    out.append((cell, f[:, 0], f[:, 1], np.full(n, -1 if doc_id is None else doc_id), np.full(n, doc_id is None), np.full(n, key), first, last, local))
                if out:
                    cell, f1, f2, ids, none, key, first, last, local = (np.concatenate(x) for x in zip(*out, strict=True))
                    columns = [cell, f1, f2, pa.array(ids, pa.int64(), mask=none), key, first, last, local]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.astype(t.type.to_pandas_dtype()), t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    return docs.select("doc_id", "key", "text").mapInArrow(run, ddl)


def matched_runs(runs: DataFrame) -> DataFrame:
    """Steps 1 and 2: the runs whose anchor is not unique, ``whole`` if all their windows are repeated, ``partner``
    if they go on (the first of each class of equal runs of an anchor that has two classes or more).

    The sorted rows stream by; of a cell of any size only its last row and last class are held."""
    schema, ddl = _schema(FOUND)

    def run(batches):
        held = None  # the last row, whose successor is not known yet, with what is known of its predecessor
        waiting = None  # the first row of the last class, if it isn't known to be a partner yet

        def flush(t, before, after):
            """Rows of table t, given the (cell, f1, f2) before and after them."""
            nonlocal waiting
            cell, f1, f2 = (t.column(c).to_numpy() for c in ("cell", "f1", "f2"))
            c, x, y = (np.concatenate([[b], v, [a]]) for v, b, a in ((cell, before[0], after[0]), (f1, before[1], after[1]), (f2, before[2], after[2])))
            cell_as_last = c[1:-1] == c[:-2]
            if before[3]:
                cell_as_last[0] = False
            as_last = cell_as_last & (x[1:-1] == x[:-2]) & (y[1:-1] == y[:-2])
            as_next = (c[1:-1] == c[2:]) & (x[1:-1] == x[2:]) & (y[1:-1] == y[2:])
            if after[3]:
                as_next[-1] = False
            whole = as_last | as_next | t.column("local").to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(~as_last)
            partner = np.zeros(len(c) - 2, bool)
            partner[starts] = cell_as_last[starts]
            follows = np.zeros(len(starts), bool)  # the next class has the same cell
            follows[:-1] = c[1:-1][starts[1:]] == c[1:-1][starts[:-1]]
            partner[starts] |= follows
            late = None
            if len(starts):
                if waiting is not None and cell_as_last[starts[0]]:
                    late = waiting
                waiting = None
                if not partner[starts[-1]]:
                    waiting = t.slice(int(starts[-1]), 1)
            keep = whole | partner
            out = t.select(["cell", "doc_id", "key", "s", "e"]).append_column("whole", pa.array(whole)).append_column("partner", pa.array(partner))
            out = out.filter(pa.array(keep))
            if late is not None:  # its interval, if whole, has gone out already
                late = late.select(["cell", "doc_id", "key", "s", "e"]).append_column("whole", pa.array([False])).append_column("partner", pa.array([True]))
                out = pa.concat_tables([out, late])
            return out.cast(schema)

        def key_of(t, i):
            return tuple(t.column(c)[i].as_py() for c in ("cell", "f1", "f2")) + (False,)

        none, before = (0, 0, 0, True), (0, 0, 0, True)
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if held is not None:
                t = pa.concat_tables([held, t]).combine_chunks()
            if t.num_rows > 1:
                out = flush(t.slice(0, t.num_rows - 1).combine_chunks(), before, key_of(t, t.num_rows - 1))
                before = key_of(t, t.num_rows - 2)
                yield from out.to_batches()
            held = t.slice(t.num_rows - 1, 1)
        if held is not None:
            yield from flush(held.combine_chunks(), before, none).to_batches()

    n = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return runs.repartition(n, "cell").sortWithinPartitions("cell", "f1", "f2").mapInArrow(run, ddl)


def by_key(df: DataFrame, keys: list[str], *then: str) -> DataFrame:
    """The rows of equal ``keys`` together, sorted by them and ``then``."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *then)


def anchored(runs: DataFrame, docs: DataFrame, length: int, gram: int) -> DataFrame:
    """CONTEXTS of the partner runs: run (unique), how many windows it has, where its anchor lies, and its bytes."""
    schema, ddl = _schema(CONTEXTS)
    of_doc = runs.groupBy("doc_id", "key").agg(F.collect_list(F.struct("s", "e")).alias("runs"))
    of_doc = of_doc.select(F.col("doc_id").alias("_i"), F.col("key").alias("_k"), "runs")
    joined = docs.join(of_doc, (F.col("key") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_i"))).select("doc_id", "key", "text", "runs")

    def run(batches):
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                for doc_id, key, text, runs in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    raw = text.encode()
                    for r in runs:
                        s, e = r["s"], r["e"]
                        context, number = raw[s : e + length], number + 1
                        h = gram_hashes(np.frombuffer(context, np.uint8), gram)[e - s : length - gram + 1]  # what all its windows hold
                        anchor = e - s + int((h >> np.uint64(32)).argmin())
                        out.append((number, doc_id, key, s, e - s + 1, anchor, context))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return joined.mapInArrow(run, ddl)


def part_of(windows: int, anchor: int, part: int, length: int, gram: int) -> tuple[int, int, int, int]:
    """First and last window of a part (first > last if the run has none), first and last byte of what they all hold."""
    width = length - gram
    near, far = part * width // PARTS, (part + 1) * width // PARTS  # distance to the anchor
    first, last = max(0, anchor - far + (part < PARTS - 1)), min(windows - 1, anchor - near)
    return first, last, anchor - near, anchor - far + (part < PARTS - 1) + length


def live_parts(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """Step 3: (run, parts), a bit for each part whose core stands in two runs or more."""
    schema, ddl = _schema({"run": "long", "part": "int", "h": "long"})

    def cores(batches):
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            out = []
            for run, windows, anchor, context in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for part in range(PARTS):
                    first, last, begin, end = part_of(windows, anchor, part, length, gram)
                    if first <= last:
                        h = xxh3_64_intdigest(context[begin:end], part)
                        out.append((run, 1 << part, h - (1 << 64) if h >> 63 else h))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    found = cut(contexts.select("run", "windows", "anchor", "context").mapInArrow(cores, ddl), "cores")
    again = cut(found.groupBy("h").count().where("count > 1").select("h"), "repeated_cores")
    return found.join(again, "h", "left_semi").groupBy("run").agg(F.sum("part").alias("parts"))


def batch_of(columns, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def first_pairs(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """(r1, r2, run, at): for every window left the ranks of its first bytes and of those ``sizes(length)[0]`` later."""
    schema, ddl = _schema({"r1": "long", "r2": "long", "run": "long", "at": "int"})
    size, _ = sizes(length)

    def pairs(batches):
        for batch in batches:
            out = []
            for run, windows, anchor, context, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                left = np.zeros(windows, bool)
                for part in range(PARTS):
                    first, last, _, _ = part_of(windows, anchor, part, length, gram)
                    if parts >> part & 1 and first <= last:
                        left[first : last + 1] = True
                at = np.flatnonzero(left)
                h = gram_hashes(np.frombuffer(context, np.uint8), size).view(np.int64)
                out.append((h[at], h[at + size], np.full(len(at), run), at))
                if len(out) >= 128:
                    yield batch_of(map(np.concatenate, zip(*out, strict=True)), schema)
                    out = []
            if out:
                yield batch_of(map(np.concatenate, zip(*out, strict=True)), schema)

    return contexts.select("run", "windows", "anchor", "context", "parts").mapInArrow(pairs, ddl)


def second_pairs(ranks: DataFrame, contexts: DataFrame, length: int) -> DataFrame:
    """(r1, r2, run, at, first): for every window of ``ranks`` the pair of its second half; first: its rank so far. A
    run's bytes come ahead of its windows in one sort, and stay until the next run's."""
    schema, ddl = _schema({"r1": "long", "r2": "long", "run": "long", "at": "int", "first": "long"})
    size, half = sizes(length)
    later = length - half

    def pairs(batches):
        h = None
        for batch in batches:
            run, at, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("run", "at", "rank"))
            begins = np.flatnonzero(at < 0)
            texts = batch.column("context").take(pa.array(begins)).to_pylist()
            out = []
            for k, (a, z) in enumerate(zip(np.r_[0, begins + 1].tolist(), np.r_[begins, len(at)].tolist(), strict=True)):
                if k:
                    h = gram_hashes(np.frombuffer(texts[k - 1], np.uint8), size).view(np.int64)
                if a < z:
                    out.append((h[at[a:z] + later], h[at[a:z] + later + size], run[a:z], at[a:z], rank[a:z].astype(np.int64)))
            if out:
                yield batch_of(map(np.concatenate, zip(*out, strict=True)), schema)

    of_run = contexts.select("run", F.lit(-1).alias("at"), F.lit(0).cast("long").alias("rank"), "context")
    both = of_run.join(ranks.select("run").distinct(), "run", "left_semi").unionByName(ranks, allowMissingColumns=True)
    return by_key(both, ["run"], "at").mapInArrow(pairs, ddl)


def reranked(pairs: DataFrame) -> DataFrame:
    """(run, at, rank, and first if there is one) of the positions whose pair (r1, r2) is not unique: Spark sorts the
    pairs, and equal ones get a common new rank. The sorted rows stream by; only the last one is held."""
    first = {"first": "long"} if "first" in pairs.columns else {}
    schema, ddl = _schema({"run": "long", "at": "int", "rank": "long"} | first)

    def rank(batches):
        r, held = TaskContext.get().partitionId() << 40, None
        before = None  # the pair ahead of the held row

        def told(rows, before, after, r):
            """Rows of equal pairs with their rank, and the last rank; before, after: the pairs around them."""
            r1, r2, run, at, *more = rows
            a, b = np.r_[before[0] if before else 0, r1, after[0] if after else 0], np.r_[before[1] if before else 0, r2, after[1] if after else 0]
            same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            same[0] &= before is not None
            same[-1] &= after is not None
            ranks = r + np.cumsum(~same[:-1])
            keep = same[:-1] | same[1:]
            return batch_of([x[keep] for x in (run, at, ranks, *more)], schema), int(ranks[-1])

        for batch in batches:
            rows = [c.to_numpy() for c in batch.columns]
            if not len(rows[0]):
                continue
            if held is not None:
                rows = [np.r_[h, x] for h, x in zip(held, rows, strict=True)]
            out, held = [x[:-1] for x in rows], [x[-1:] for x in rows]
            if len(out[0]):
                batch, r = told(out, before, (held[0][0], held[1][0]), r)
                before = out[0][-1], out[1][-1]
                yield batch
        if held is not None:
            yield told(held, before, None, r)[0]

    return by_key(pairs, ["r1", "r2"]).mapInArrow(rank, ddl)


def whole_runs(batches):
    """Columns of the rows of whole runs (sorted by run and at) out of batches: a run has LENGTH rows or so."""
    held = None
    for batch in batches:
        rows = [c.to_numpy() for c in batch.columns]
        if held is not None:
            rows = [np.r_[h, x] for h, x in zip(held, rows, strict=True)]
        if not len(rows[0]):
            continue
        last = int(np.searchsorted(rows[0], rows[0][-1], "left"))
        held = [x[last:] for x in rows]
        if last:
            yield [x[:last] for x in rows]
    if held is not None and len(held[0]):
        yield held


def stretches(left: DataFrame) -> DataFrame:
    """(run, a, z): the first and last window of each stretch of positions that are left."""
    schema, ddl = _schema({"run": "long", "a": "int", "z": "int"})

    def joined(batches):
        for run, at, _ in whole_runs(batches):
            new = np.r_[True, (run[1:] != run[:-1]) | (at[1:] != at[:-1] + 1)]
            ends = np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1]
            yield batch_of((run[new], at[new], at[ends]), schema)

    return by_key(left, ["run"], "at").mapInArrow(joined, ddl)


def doubled(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """Steps 3 and 4: (doc_id, key, s, e), the first and last window of stretches of repeated windows."""
    live = cut(live_parts(contexts, length, gram), "live")

    def step(df: DataFrame, name: str, *done: DataFrame) -> DataFrame:
        out = cut(df, name)
        for table in done:
            drop_table(table)
        return out

    first = step(reranked(first_pairs(contexts.join(live, "run"), length, gram)), "first_halves", live)
    both = step(reranked(second_pairs(first, contexts, length)), "second_halves", first)
    last = both.select(F.col("first").alias("r1"), F.col("rank").alias("r2"), "run", "at")
    found = step(stretches(reranked(last)), "repeated", both)
    where = contexts.select("run", "doc_id", "key", "s")
    return found.join(where, "run").select("doc_id", "key", (F.col("s") + F.col("a")).alias("s"), (F.col("s") + F.col("z")).alias("e"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(docs with doc_id, key, text; spans with doc_id, key, s, e): in the text with that id and key, every window
    that starts at a byte from s to e is repeated somewhere in the table."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("key"), text.alias("text"))
    found = cut(matched_runs(sampled_runs(rows, length, gram)), "runs")
    contexts = cut(anchored(found.where("partner"), rows, length, gram), "contexts")
    more = cut(doubled(contexts, length, gram), "stretches")
    return rows, found.where("whole").select("doc_id", "key", "s", "e").union(more)


def merged(spans: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal byte runs [begin, end) that the windows cover; runs that touch are one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e + length))
        else:
            out.append((s, e + length))
    return out


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """One row per input row: doc_id, key, kept (the remaining bytes, binary), removed (array of begin and end
    offsets); with ``digest`` instead doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes, a null one is empty; a text shorter than ``length`` loses nothing. All places of a
    repeated string are removed, the first one too; rows repeated with one id are different places, so they lose
    what they share. Null ids are ids like others. Other columns are not read; empty in, empty out.
    """
    rows, spans = repeated_spans(docs, id_col, text_col, length, gram)
    of_doc = spans.groupBy("doc_id", "key").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    of_doc = of_doc.select(F.col("doc_id").alias("_i"), F.col("key").alias("_k"), "spans")
    joined = rows.join(of_doc, (F.col("key") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_i")), "left").select("doc_id", "key", "text", "spans")
    columns = {"doc_id": "long", "key": "long", "kept": "binary", "removed": "array<int>"}
    if digest:
        columns = {"doc_id": "long", "n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"}
    schema, ddl = _schema(columns)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for doc_id, key, text, spans in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    raw, upto, kept = text.encode(), 0, []
                    gone = merged([(x["s"], x["e"]) for x in spans or ()], length)
                    for a, b in gone:
                        kept.append(raw[upto:a])
                        upto = b
                    left = b"".join([*kept, raw[upto:]])
                    if digest:
                        out.append((doc_id, len(raw), len(raw) - len(left), len(gone), hashlib.sha256(left).hexdigest()))
                    else:
                        out.append((doc_id, key, left, [x for ab in gone for x in ab]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return joined.mapInArrow(run, ddl)


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_chars", **how) -> DataFrame:
    """``docs`` with all columns, the repeated bytes gone from the text and ``count_col``, where there is one, set to
    its new number of characters. A character that loses one of its bytes goes whole. No row goes: a null text stays
    null, a text that repeats in full becomes empty, and rows are told apart by id and text, so a null id is an id like
    others and rows that repeat in full lose the same bytes. Columns _key, _i, _k and _spans are its own; empty in,
    empty out."""
    length = how.get("length", LENGTH)
    _, spans = repeated_spans(docs, id_col, text_col, **how)
    of_doc = spans.groupBy("doc_id", "key").agg(F.collect_list(F.struct("s", "e")).alias("_spans"))
    of_doc = of_doc.select(F.col("doc_id").alias("_i"), F.col("key").alias("_k"), "_spans")
    keyed = docs.withColumn("_key", F.xxhash64(F.col(id_col), text_of(text_col)))
    joined = keyed.join(of_doc, (F.col("_key") == F.col("_k")) & F.col(id_col).eqNullSafe(F.col("_i")), "left")

    @F.pandas_udf("string")
    def stripped(texts, spans):
        import pandas as pd

        out = []
        for text, found in zip(texts, spans, strict=True):
            if found is not None and len(found):
                raw, upto, kept = text.encode(), 0, []
                for a, b in merged([(x["s"], x["e"]) for x in found], length):
                    kept.append(raw[upto:a])
                    upto = b
                text = "".join(x.decode("utf-8", "ignore") for x in [*kept, raw[upto:]])
            out.append(text)
        return pd.Series(out, dtype=object)

    out = joined.withColumn(text_col, stripped(F.col(text_col), F.col("_spans")))
    if count_col in docs.columns:
        out = out.withColumn(count_col, F.length(text_col).cast(docs.schema[count_col].dataType))
    return out.select(*docs.columns)


def op5_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), digest=True)


QUERIES = {"op5_prefix_doubling": op5_prefix_doubling}
ORACLE_SQL: dict[str, str] = {}
