"""Packing documents into windows of a fixed number of tokens, by lexical retrieval.

A document gives as many full windows as it can; what is left over is packed with others. Document frequencies and
the average length are counted once, over the whole texts of all documents with a left-over. The left-overs are dealt
to shards of bounded size in the order of weighted min-hashes of their terms, so documents that share much tend to
meet. Each shard has a BM25 inverted index over the whole texts; a seed document opens a window, its best unused
neighbours fill it, and the last of them is cut where the window ends, its rest being the next seed. So only the last
window of a shard is not full.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .numbering import positions
from .token_store import packed, unpacked
from .tokens import PA, column_encoder, map_rows

VOCABULARY, END_ID, WINDOW = "byte_bpe_50k.json", 0, 1024
#: Documents of a shard, on average.
SHARD_DOCS = 4096
#: Min-hashes of a document's place and their bits.
HASHES, HASH_BITS = 3, 20
#: BM25; terms in more than DENSE_SHARE of a shard's left-overs are kept as rows of weights, not as posting lists.
K1, B, DENSE_SHARE = 1.2, 0.75, 0.125

PIECES = {
    "doc_id": "long", "start": "long", "length": "long", "ids_crc32": "long", "doc_tokens": "long",
    "sequence_id": "long", "offset": "long",
}


class Corpus(NamedTuple):
    """Documents, their average length, and by term the documents that have it."""

    n: int
    mean: float
    df: np.ndarray

    def idf(self) -> np.ndarray:
        return np.log1p((self.n - self.df + 0.5) / (self.df + 0.5))


def corpus_of(staged: DataFrame) -> Corpus:
    """The sum of what the tasks of ``left_overs`` have counted; the driver gets one row for each term of the vocabulary."""

    def count(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for tokens, n, terms in zip(*(c.to_pylist() for c in b.columns), strict=True):
                term, df = np.split(unpacked(terms, unpack).astype(np.int64), 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, term]), pa.array(np.r_[tokens, n[0], df])], ["term", "n"])

    counts = staged.where("row < 0").select("doc_tokens", "crcs", "terms").mapInArrow(count, "term long, n long")
    rows = counts.groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    found = dict(zip(*(rows[c].to_pylist() for c in ("term", "n")), strict=True))
    tokens, n = found.pop(-2, 0), found.pop(-1, 0)
    df = np.zeros(max(found, default=0) + 1, np.int64)
    df[list(found)] = list(found.values())
    return Corpus(n, tokens / max(n, 1), df)


def places(corpus: Corpus):
    """A function from documents' terms to one number each. It is made of HASHES min-hashes, weighted by IDF, of the
    terms that two documents or more have; two documents agree in one as often as their weighted terms do."""
    ranks, last = [], (1 << HASH_BITS) - 1
    with np.errstate(divide="ignore"):
        for k in range(HASHES):
            chance = -np.log(1 - np.random.default_rng(k).random(len(corpus.df))) / corpus.idf()
            rank = np.empty(len(chance), np.int64)
            rank[np.argsort(chance, kind="stable")] = np.arange(len(chance))
            ranks.append(np.where(corpus.df > 1, np.minimum(rank, last), last))

    ranks = [np.append(rank, last) for rank in ranks]  # of a number behind all terms, which every document has
    none = np.array([len(corpus.df)])

    def place(terms: list[np.ndarray]) -> np.ndarray:
        begins = np.cumsum([0, *(len(t) + 1 for t in terms)])[:-1]
        both = np.concatenate([x for t in terms for x in (t, none)]).astype(np.int64)
        out = np.zeros(len(terms), np.int64)
        for rank in ranks:
            out = out << HASH_BITS | np.minimum.reduceat(rank[both], begins)
        return out

    return place


def dealt(staged: DataFrame, corpus: Corpus, shard_docs: int) -> DataFrame:
    """``staged`` with its shard: rows in the order of their place, and of their number where that is equal, cut into
    shards of equal size. Spark sorts places and numbers by ranges; the driver sees neither rows nor bounds."""
    places_of, staged = places(corpus), staged.where("row >= 0")

    def run(terms: pd.Series) -> pd.Series:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        return pd.Series(places_of([np.split(unpacked(t, unpack), 2)[0] for t in terms]) if len(terms) else [], dtype="int64")

    rows = staged.select("row", F.pandas_udf(run, "long")("terms").alias("place"), F.lit(0).alias("all"))
    rows = positions(cut(rows, "placed"), "all", ["place", "row"], "places")
    shards = F.ceil(F.col("n") / shard_docs)
    return staged.join(rows.select("row", F.floor(F.col("pos") * shards / F.col("n")).cast("long").alias("shard")), "row")


class ShardIndex:
    """BM25 over a shard's left-overs; token ids are the terms, and every one counts.

    ``alive``: the documents that are still scored; ``keep`` takes the others from the index.
    """

    def __init__(self, texts: list[np.ndarray], found: list[tuple[np.ndarray, np.ndarray]] | None = None, corpus: Corpus | None = None):
        """found: terms and counts of each document where ``texts`` are but their ends. corpus: what the statistics
        are of; these documents, if not given."""
        n = len(texts)
        found = [np.unique(x, return_counts=True) for x in texts] if found is None else found
        sizes = np.array([len(t) for t, _ in found], np.int64)
        term = np.concatenate([t for t, _ in found]).astype(np.int64) if n else np.empty(0, np.int64)
        tf = np.concatenate([c for _, c in found]).astype(np.float64) if n else np.empty(0)
        doc = np.repeat(np.arange(n), sizes)
        df = np.bincount(term, minlength=1)
        length = np.bincount(doc, tf, n)
        corpus = corpus or Corpus(n, length.mean() if n else 1.0, df)
        idf = corpus.idf()
        norm = K1 * (1 - B + B * length / max(corpus.mean, 1.0))
        weight = (idf[term] * tf * (K1 + 1) / (tf + norm[doc])).astype(np.float32)
        self.alive = np.arange(n)
        self.terms = np.split(term, np.cumsum(sizes)[:-1]) if n else []
        dense = df > max(2, DENSE_SHARE * n)
        self.row = np.where(dense, np.cumsum(dense) - 1, -1)
        self.rows = np.zeros((int(dense.sum()), n), np.float32)
        often = dense[term]
        self.rows[self.row[term[often]], doc[often]] = weight[often]
        order = np.flatnonzero(~often)
        order = order[np.argsort(term[order], kind="stable")]
        self._post(term[order], doc[order], weight[order])

    def _post(self, term: np.ndarray, doc: np.ndarray, weight: np.ndarray) -> None:
        self.term, self.doc, self.weight = term, doc, weight
        size = np.bincount(term, minlength=len(self.row))
        self.end = np.cumsum(size)
        self.begin = self.end - size

    def keep(self, wanted: np.ndarray) -> None:
        """Score only the documents that ``wanted`` marks."""
        stay = wanted[self.alive]
        self.alive, self.rows = self.alive[stay], np.ascontiguousarray(self.rows[:, stay])
        told = stay[self.doc]
        self._post(self.term[told], (np.cumsum(stay) - 1)[self.doc[told]], self.weight[told])

    def scores(self, i: int) -> np.ndarray:
        """BM25 of the documents ``alive`` for the terms of document i."""
        t = self.terms[i]
        begin, size = self.begin[t], self.end[t] - self.begin[t]
        at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        row = self.row[t]
        often = np.zeros(len(self.alive), np.float32)
        for k in row[row >= 0].tolist():
            often += self.rows[k]
        return np.bincount(self.doc[at], self.weight[at], len(self.alive)) + often


def fill(texts: list[np.ndarray], window: int, index: ShardIndex | None = None) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece of a shard's left-overs."""
    index, out = index or ShardIndex(texts), []
    unused = np.array([len(x) > 0 for x in texts])
    at, sequence, upto, seed = [0] * len(texts), 0, 0, None
    following = iter(range(len(texts)))
    while True:
        if seed is None:
            seed = next((i for i in following if unused[i]), None)
            if seed is None:
                return out
            unused[seed] = False
        score, doc = None, seed
        while doc is not None:
            length = min(len(texts[doc]) - at[doc], window - upto)
            out.append((doc, at[doc], length, sequence, upto))
            at[doc] += length
            upto += length
            if upto == window:
                seed = doc if at[doc] < len(texts[doc]) else None
                sequence, upto = sequence + 1, 0
                break
            if score is None:
                left = unused[index.alive]
                if 4 * left.sum() < 3 * len(left):
                    index.keep(unused)
                score = np.where(unused[index.alive], index.scores(seed), -1.0)
            place = int(score.argmax()) if len(score) else -1
            if place < 0 or score[place] < 0:
                doc = None
            elif score[place] == 0:  # no neighbour is left that shares a term
                doc = next((i for i in following if unused[i]), int(index.alive[place]))
            else:
                doc = int(index.alive[place])
            if doc is not None:
                unused[doc] = False
                score[np.searchsorted(index.alive, doc)] = -1.0
        else:
            return out


def left_overs(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int, window: int, with_ids: bool) -> DataFrame:
    """doc_id, row (unique), doc_tokens, crcs (of the full windows), head (their ids, if asked for), tail, terms (ids
    of the whole text, ascending, then how often each stands there; none if the tail is empty). Row -1 of each task has
    what it counted over its documents with a tail: their tokens, their number (as crcs), and by term how many have it."""

    def start():
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        rows = iter(range(TaskContext.get().partitionId() << 33, 1 << 63))
        seen, df = [0, 0], np.zeros(1 << 16, np.uint32)

        def one(doc_id, ids):
            ids = np.append(ids, np.uint32(end_id))
            raw, full = memoryview(ids).cast("B"), len(ids) // window
            crcs = [zlib.crc32(raw[4 * k * window : 4 * (k + 1) * window]) for k in range(full)]
            head = packed(ids[: full * window], pack) if with_ids else None
            tail = ids[full * window :]
            terms = tail
            if len(tail):
                nonlocal df
                found, often = np.unique(ids, return_counts=True)
                if found[-1] >= len(df):
                    df = np.append(df, np.zeros(int(found[-1]) + 1, np.uint32))
                df[found] += 1
                seen[0] += len(ids)
                seen[1] += 1
                terms = np.concatenate([found, often])
            yield doc_id, next(rows), len(ids), crcs, head, packed(tail, pack), packed(terms, pack)

        def last():
            term = df.nonzero()[0]
            yield None, -1, seen[0], [seen[1]], None, packed(df[:0], pack), packed(np.concatenate([term, df[term]]), pack)

        return one, last

    def values(batch):
        return zip(batch.column(0).to_pylist(), column_encoder(path, spaced=True)(batch.column(1)), strict=True)

    columns = {"doc_id": "long", "row": "long", "doc_tokens": "long", "crcs": "array<long>", "head": "binary", "tail": "binary", "terms": "binary"}
    return map_rows(docs.select(F.col(id_col), F.col(text_col)), start, columns, 500, values)


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID,
    window: int = WINDOW, shard_docs: int = SHARD_DOCS, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with ``with_ids`` also
    ids (little-endian unsigned 32-bit, binary).

    Every id of every document, its end id included, lies in exactly one piece. A null text counts as empty: its
    end id alone. Repeated rows are documents of their own, null ids pass through, other columns are not read,
    empty in, empty out. Copies lie in one shard, or in several neighbouring ones if they are too many for one.
    """
    staged = cut(left_overs(docs, id_col, text_col, tokenizer or public_tokenizers.path(VOCABULARY), end_id, window, with_ids), "left_overs")
    corpus = corpus_of(staged)
    columns = PIECES | ({"ids": "binary"} if with_ids else {})
    schema = pa.schema([(c, PA[t]) for c, t in columns.items()])

    def shard(key, rows):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        rows = rows.sort_by("row")
        ids, total, crcs, tails, heads, terms = (rows[c].to_pylist() for c in ("doc_id", "doc_tokens", "crcs", "tail", "head", "terms"))
        tails = [unpacked(t, unpack) for t in tails]
        found = [np.split(unpacked(t, unpack), 2) for t in terms]
        first, out = key[0].as_py() << 32, []
        pieces = fill(tails, window, ShardIndex(tails, found, corpus))
        for doc, start, length, sequence, offset in pieces:
            raw = tails[doc][start : start + length].tobytes()
            out.append((ids[doc], len(crcs[doc]) * window + start, length, zlib.crc32(raw), total[doc], first + sequence, offset, raw))
        sequence = pieces[-1][3] + 1 if pieces else 0
        for doc, full in enumerate(crcs):
            head = unpacked(heads[doc], unpack).tobytes() if with_ids else b""
            for k, crc in enumerate(full):
                out.append((ids[doc], k * window, window, crc, total[doc], first + sequence, 0, head[4 * k * window : 4 * (k + 1) * window]))
                sequence += 1
        values = list(zip(*out, strict=True)) or [()] * 8
        return pa.table([pa.array(v, f.type) for v, f in zip(values, schema, strict=False)], schema=schema)

    return dealt(staged, corpus, shard_docs).groupBy("shard").applyInArrow(shard, ", ".join(f"`{c}` {t}" for c, t in columns.items()))


def op6_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op6_retrieval_packing": op6_retrieval_packing}
ORACLE_SQL: dict[str, str] = {}
