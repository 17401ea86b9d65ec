"""Phrases whose words stand together more often than their parts would.

Each task keeps a shard of its texts as word numbers and builds a suffix automaton over all of the shard's pieces, bounded
to the longest phrase: its states are classes of phrases with the same end places, with a length, a link to the longest
shorter suffix of another class, and the number of end places. As no phrase is longer than the bound, the states and links
come from sorting end places by the words before them, read backwards, rather than from adding words one by one. The
phrases of the states go out with their counts, and Spark adds those of all shards, one length of phrase after the other:
a phrase can only be frequent if both of its parts that are one word shorter are, so the automata of a length leave out
what a bitmap of the frequent shorter ones rules out. A frequent phrase then hands its count along its link (itself without
the first word) and along the mirrored one (without the last word) to what it contains.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .numbering import positions

#: Words of a phrase, occurrences it needs, percent of its occurrences that a longer one may take up, phrases reported.
MAX_WORDS, LEAST, SHARE, TOP = 3, 10, 50, 2000
NO_LANG = "und"
#: Words of a shard, words that a task remembers from shard to shard, rows of a batch, texts taken from Arrow at a time.
SHARD_WORDS, KEPT_WORDS, BATCH_ROWS, TEXTS = 1 << 19, 1 << 18, 1 << 16, 256
#: Bits of the map of frequent phrases, a multiple of 32768: 8 MB. It rules out less when more phrases than that are frequent.
FILTER_BITS = 1 << 26
#: A-Z to a-z, and every mark that ends a piece to a full stop; no other byte of UTF-8 text changes.
_ENDS = bytes([*b".,;:!?", *range(0x0A, 0x0E)])
_CHANGE = bytes.maketrans(bytes(range(65, 91)) + _ENDS, bytes(range(97, 123)) + b"." * len(_ENDS))


def tokens(text: str) -> list[bytes]:
    """The words of a text in UTF-8, a full stop where a piece ends."""
    return text.encode().translate(_CHANGE).replace(b".", b" . ").split()


class Numbers(dict):
    """Words to numbers in the order they come; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Automaton(NamedTuple):
    """States: longest phrase, link (-1: the empty phrase) and its length, end places; words, the longest phrase
    backwards, one row for each place. State k stands for its phrases of more than link_length to length words."""

    length: np.ndarray
    link: np.ndarray
    link_length: np.ndarray
    count: np.ndarray
    words: np.ndarray


def automaton(ids: np.ndarray, depth: int) -> Automaton:
    """The bounded suffix automaton of pieces of word numbers, zeros between them."""
    padded = np.r_[np.zeros(depth, np.int64), ids]
    ends = np.flatnonzero(padded)
    back = [padded[ends]]
    for d in range(1, depth):
        back.append(np.where(back[-1] > 0, padded[ends - d], 0))
    bits = max(1, int(padded.max(initial=0)).bit_length())
    if bits * depth <= 63:
        key = reduce(lambda a, b: a << bits | b, back)
        key.sort()
        back = [key >> bits * (depth - 1 - d) & (1 << bits) - 1 for d in range(depth)]
    else:
        order = np.lexsort(back[::-1])
        back = [b[order] for b in back]
    m = len(ends)
    new, first, run, size, valid = np.zeros(m, bool), [], [], [], []
    new[:1] = True
    for d in range(depth):
        new[1:] |= back[d][1:] != back[d][:-1]
        first.append(np.flatnonzero(new))
        run.append(np.cumsum(new, dtype=np.int32) - 1)
        size.append(np.diff(np.r_[first[d], m]))
        valid.append(back[d][first[d]] > 0)
    state, n, parts = [None] * depth, 0, []
    for d in reversed(range(depth)):
        mine = np.full(len(first[d]), -1)
        if d + 1 < depth:  # a phrase that always follows the same word has the end places of the longer one
            parent = run[d][first[d + 1]]
            same = valid[d + 1] & (size[d + 1] == size[d][parent])
            mine[parent[same]] = state[d + 1][same]
        own = np.flatnonzero(valid[d] & (mine < 0))
        mine[own] = n + np.arange(len(own))
        n, state[d] = n + len(own), mine
        parts.append((d, own))
    length = np.concatenate([np.full(len(own), d + 1) for d, own in parts])
    count = np.concatenate([size[d][own] for d, own in parts])
    at = np.concatenate([first[d][own] for d, own in parts])
    link, link_length = np.full(n, -1), np.zeros(n, np.int64)
    for d in range(depth - 1):  # the longest suffix in another class, if there is one
        s = np.where(length > d + 1, state[d][run[d][at]], np.arange(n))
        other = s != np.arange(n)
        link[other], link_length[other] = s[other], d + 1
    return Automaton(length, link, link_length, count, np.stack([b[at] for b in back]) if depth else np.empty((0, 0)))


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def places(lang: str, words: list[np.ndarray]) -> np.ndarray:
    """The bits (from 0) of phrases, given the hashes of their words in order."""
    h = np.full(len(words[0]), xxhash.xxh64_intdigest(lang.encode()), np.uint64)
    for w in words:
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + w
    return ((h ^ (h >> np.uint64(32))) % np.uint64(FILTER_BITS)).astype(np.int64)


def bitmap(frequent: DataFrame) -> np.ndarray:
    """A bit for each of the phrases (lang, phrase), all of one length. Its size is fixed, whatever the rows are; that is
    what the driver gets and the tasks are sent. Bits that phrases share cost time, not results."""

    def run(batches):
        for b in batches:
            langs, split = b.column(0).to_pylist(), [p.encode().split(b" ") for p in b.column(1).to_pylist()]
            at = np.zeros(len(langs), np.int64)
            for lang in set(langs):
                mine = [k for k, x in enumerate(langs) if x == lang]
                at[mine] = places(lang, [hashes([split[k][n] for k in mine]) for n in range(len(split[0]))])
            yield pa.RecordBatch.from_arrays([pa.array(at + 1)], ["bit"])

    rows = frequent.select("lang", "phrase").mapInArrow(run, "bit long").groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out, found = np.zeros(FILTER_BITS // 8, np.uint8), rows.toArrow()
    for k, bits in zip(found["k"].to_pylist(), found["bits"].to_pylist(), strict=True):
        out[(k - 1) * len(bits) : k * len(bits)] = np.frombuffer(bits, np.uint8)
    return out


def phrases(a: Automaton, n: int, allowed=None) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """The phrases of n words of all states, as word numbers in order, with their counts; ``allowed``: of such phrases
    (arrays of word numbers) those that may be frequent."""
    has = np.flatnonzero((a.link_length < n) & (n <= a.length))
    for at in range(0, len(has), BATCH_ROWS):
        part = has[at : at + BATCH_ROWS]
        words = [a.words[k, part] for k in reversed(range(n))]
        if allowed is not None:
            stay = allowed(words)
            part, words = part[stay], [w[stay] for w in words]
        yield words, a.count[part]


def shard_counts(docs: DataFrame, text_col: str, lang_col: str, length: int, known: list, shard_words: int) -> DataFrame:
    """lang, phrase, n: the counts of phrases of this length in every shard; with the words (length 1) also the empty
    phrase, counted at every word. known: broadcast bitmaps of the frequent phrases of lengths 1 to length - 1.

    A shard is as many texts of one task as hold ``shard_words`` words; what a task keeps in memory depends on that and
    its longest text only."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])

    def run(batches):
        numbers, held, total = Numbers(), {}, 0

        def counted():
            words = list(numbers)
            spelled, hashed = pa.array(words, pa.binary()).cast(pa.string()), hashes(words) if length > 1 else None

            def frequent(lang, numbers):
                at, bits = places(lang, [hashed[w] for w in numbers]), known[len(numbers) - 1].value
                return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

            def rows(lang, ids):
                if length == 1:
                    yield [], np.array([np.count_nonzero(ids)])
                    yield from phrases(automaton(ids, 1), 1)
                    return
                stay = frequent(lang, [np.arange(len(words))])
                stay[0] = False
                found = automaton(np.where(stay[ids], ids, 0), length)
                parts = (lambda x: frequent(lang, x[1:]) & frequent(lang, x[:-1])) if length > 2 else None
                yield from phrases(found, length, parts)

            for lang, parts in held.items():
                for found, n in rows(lang, np.concatenate(parts)):
                    phrase = pc.binary_join_element_wise(*[spelled.take(pa.array(w)) for w in found], " ") if found else pa.array([""])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), phrase, pa.array(n, pa.int64())], schema=schema)

        for b in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = tokens(text or "")
                if not words:
                    continue
                ids = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
                held.setdefault(NO_LANG if lang is None else lang, []).append(np.append(ids, np.int32(0)))
                total += len(ids) + 1
                if total >= shard_words:
                    yield from counted()
                    held, total = {}, 0
                    numbers = numbers if len(numbers) < KEPT_WORDS else Numbers()
        yield from counted()

    return docs.select(F.col(lang_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(run, "lang string, phrase string, n long")


def frequent_phrases(docs: DataFrame, text_col: str, lang_col: str, max_words: int, least: int, shard_words: int) -> DataFrame:
    """lang, phrase, words, a: the phrases of up to ``max_words`` words with ``least`` occurrences or more, and for each
    language the empty phrase with all its words; one pass over the texts for each length."""
    context, known, out = docs.sparkSession.sparkContext, [], []
    for length in range(1, max_words + 1):
        counts = shard_counts(docs, text_col, lang_col, length, known, shard_words).groupBy("lang", "phrase").agg(F.sum("n").alias("a"))
        counts = counts.where((F.col("a") >= least) | (F.col("phrase") == ""))
        out.append(cut(counts.select("lang", "phrase", F.when(F.col("phrase") == "", 0).otherwise(length).alias("words"), "a"), f"frequent_{length}"))
        if length < max_words:
            known = [*known, context.broadcast(bitmap(out[-1].where("words > 0")))]
    return reduce(DataFrame.unionByName, out)


def part(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(frequent: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of every phrase of two words or more: its lowest-scoring cut."""
    words = F.split("phrase", " ")
    cuts = frequent.where("words > 1").withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
    cuts = cuts.select("lang", "phrase", "a", "k", part(words, F.lit(1), F.col("k")).alias("_left"), part(words, F.col("k") + 1, F.col("words")).alias("_right"))
    for side, name in (("_left", "l"), ("_right", "r")):
        cuts = cuts.join(frequent.select("lang", F.col("phrase").alias(side), F.col("a").alias(name)), ["lang", side]).drop(side)
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumns({"_up": F.lit(1_000_000).cast("decimal(7,0)") * (exact("a") * exact("a")), "_down": exact("l") * exact("r")})
    score = F.struct(F.expr("_up div _down").alias("score"), "k", "l", "r")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(score).alias("x"))
    return best.select("lang", "phrase", "a", "x.l", "x.r", "x.score")


def subsumed(frequent: DataFrame, max_words: int, share: int) -> DataFrame:
    """(lang, phrase) of the phrases that a longer frequent one, with ``share`` percent of their occurrences or more,
    contains. Counts go down link by link: the most that any longer phrase has, one word less at a time."""
    down, gone = None, []
    for n in range(max_words, 1, -1):
        mine = frequent.where(F.col("words") == n).select("lang", "phrase", "a")
        if down is not None:
            mine = mine.join(down, ["lang", "phrase"], "left")
            gone.append(mine.where(100 * F.col("most") >= share * F.col("a")).select("lang", "phrase"))
            mine = mine.withColumn("a", F.greatest("a", "most"))
        if n > 2:
            words = F.split("phrase", " ")
            shorter = F.array(part(words, F.lit(2), F.lit(n - 1)), part(words, F.lit(1), F.lit(n - 1)))
            down = cut(mine.select("lang", F.explode(shorter).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most")), f"links_{n}")
    return reduce(DataFrame.unionByName, gone) if gone else frequent.select("lang", "phrase").limit(0)


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, least: int = LEAST, share: int = SHARE, top: int = TOP, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language.

    Texts are lower-cased (A-Z), cut at ``[.,;:!?\\x0A-\\x0D]`` and then into words between spaces and tabs. A phrase has 2
    to ``max_words`` words of one piece and ``least`` occurrences or more (a); l and r are the occurrences of its parts
    at the cut of least score, n the words of the language. A phrase goes if a longer one contains it and has ``share``
    percent of its occurrences.

    A null language counts as ``und``, a null text as empty; empty texts and an empty table give no rows. Repeated rows
    count as often as they stand there, ties are ordered by the phrase's bytes. Other columns are not read.

    Skew: shards hold any mix of languages, so neither a hot one nor a hot phrase meets before it is counted; phrases
    below ``least`` leave in the reduction. Ranks come from ranges over all tasks; only the first ``top`` rows of a language
    meet, for its n.
    """
    counts = frequent_phrases(docs, text_col, lang_col, max_words, least, shard_words)
    frequent, total = counts.where("words > 0"), counts.where("words = 0").select("lang", F.col("a").alias("n"))
    stay = cut(scored(frequent), "scored").join(cut(subsumed(frequent, max_words, share), "subsumed"), ["lang", "phrase"], "left_anti")
    ranked = positions(stay.withColumns({"_score": -F.col("score"), "_a": -F.col("a")}), "lang", ["_score", "_a", "phrase"], "ranked")
    stay = ranked.where(F.col("pos") < top).withColumn("rank", F.col("pos") + 1).drop("n")
    return stay.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op11_collocations": op11_collocations}
ORACLE_SQL = {
    "op11_collocations": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d, unnest(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
q AS (SELECT lang, row_number() OVER () AS pid, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
o AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM q),
g AS (SELECT lang, len(x) AS words, array_to_string(x, ' ') AS phrase, x, count(*) AS a FROM (
  SELECT lang, w[i:i + k] AS x FROM o, (VALUES (0), (1), (2)) v(k) WHERE i + k <= len(w)) GROUP BY lang, x),
n AS (SELECT lang, sum(a) AS n FROM g WHERE words = 1 GROUP BY lang),
c AS (SELECT * FROM g WHERE words > 1 AND a >= 10),
s AS (SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, ((1000000::HUGEINT * c.a * c.a) // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, words)) AS k FROM c) c
  JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(c.x[1:k], ' ') JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(c.x[k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
z AS (SELECT b.* FROM b WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT lang, a AS longer, unnest([array_to_string(x[1:2], ' '), array_to_string(x[2:3], ' ')]) AS part FROM c WHERE words = 3) t
  WHERE t.lang = b.lang AND t.part = b.phrase AND 100 * t.longer >= 50 * b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score
FROM z JOIN n USING (lang) QUALIFY rank <= 2000"""
}
