"""Language identification in two steps: the family first, then the language within it.

Both steps are one-versus-one linear support vector machines over hashed byte bigrams and trigrams of the whole
lower-cased text. They are fitted here, on a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table
from .tokens import map_rows

#: Families of languages by code; a code that is not listed is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "pl": "slavic", "cs": "slavic", "uk": "slavic", "bg": "slavic", "sr": "slavic",
}
#: The sample: at most so many labelled rows in all and for each language.
SAMPLE_ROWS, SAMPLE_OF_LANGUAGE = 2400, 600
BUCKETS = 4096
EPOCHS, COST = 12, 1.0
UNKNOWN = "und"
#: The pipeline rejects a document whose language scores less.
LEAST_SCORE = 0.3
_WORDLIKE = re.compile(r"[^\W\d_]+")
_ONLY_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for m in _WORDLIKE.finditer(text) for c in m.group())


def features(text: str) -> np.ndarray:
    """Square roots of hashed bigram and trigram counts, of length one."""
    b = np.frombuffer(b" " + text.lower().encode().translate(_ONLY_LETTERS) + b" ", np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(256) + b[1:]
    three = two[:-1] * np.uint32(256) + b[2:]
    shift = np.uint32(32 - (BUCKETS.bit_length() - 1))
    counts = np.bincount((two * np.uint32(2246822519)) >> shift, minlength=BUCKETS)
    counts = counts + np.bincount((three * np.uint32(2654435761)) >> shift, minlength=BUCKETS)
    x = np.sqrt(counts).astype(np.float32)
    return x / max(float(np.linalg.norm(x)), 1e-9)


def fit_svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, seed: int = 7) -> np.ndarray:
    """Weights (the last one is the bias) of a linear SVM over some rows of x, by dual coordinate descent; y holds -1
    or 1 for each of them. The rows are read where they lie."""
    w, bias, a, rng = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    size = [float(x[r] @ x[r]) + 1.0 for r in rows]
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            one = x[rows[i]]
            g = y[i] * (float(one @ w) + bias) - 1
            new = min(max(a[i] - g / size[i], 0.0), COST)
            if new != a[i]:
                step = (new - a[i]) * y[i]
                w += np.float32(step) * one
                bias += step
                a[i] = new
    return np.append(w, np.float32(bias))


class OneVersusOne:
    """Classes and a weight vector for each pair of them; the most votes win, then the larger margins."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, among: np.ndarray | None = None):
        """among: the rows of x to learn from, all if None."""
        among = np.arange(len(labels)) if among is None else among
        labels = labels[among]
        self.classes = sorted(set(labels.tolist()))
        self.pairs = list(combinations(range(len(self.classes)), 2))
        w = []
        for i, j in self.pairs:
            rows = np.flatnonzero((labels == self.classes[i]) | (labels == self.classes[j]))
            w.append(fit_svm(x, among[rows], np.where(labels[rows] == self.classes[i], 1.0, -1.0)))
        self.w = np.array(w, np.float32).reshape(len(w), BUCKETS + 1)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """The class and a confidence of 0.5 to 1."""
        if not self.pairs:
            return self.classes[0], 1.0
        m = self.w[:, :-1] @ x + self.w[:, -1]
        votes, margins = np.zeros(len(self.classes)), np.zeros(len(self.classes))
        for (i, j), v in zip(self.pairs, m.tolist(), strict=True):
            votes[i if v >= 0 else j] += 1
            margins[i] += v
            margins[j] -= v
        best = max(range(len(self.classes)), key=lambda c: (votes[c], margins[c], -c))
        least = min(v if i == best else -v for (i, j), v in zip(self.pairs, m.tolist(), strict=True) if best in (i, j))
        return self.classes[best], float(1 / (1 + np.exp(-4 * max(least, 0.0))))


class Hierarchy:
    def __init__(self, x: np.ndarray, langs: list[str], families: dict[str, str]):
        langs = np.array(langs, dtype=object)
        of = np.array([families.get(v, v) for v in langs], dtype=object)
        self.families = OneVersusOne(x, of)
        self.within = {f: OneVersusOne(x, langs, np.flatnonzero(of == f)) for f in self.families.classes}

    def predict(self, text: str | None) -> tuple[str, float]:
        if not has_letter(text):
            return UNKNOWN, 0.0
        x = features(text)
        family, sure = self.families.predict(x)
        lang, also = self.within[family].predict(x)
        return lang, sure * also


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", families: dict[str, str] | None = None) -> Hierarchy | None:
    """The classifier, from labelled rows that aren't held out; None if there are none with a letter.

    The sample is bounded: SAMPLE_OF_LANGUAGE rows of a language, SAMPLE_ROWS in all (but one row of each language at
    least), in the order of a hash of the id. Features are made on the executors; the driver gets at most SAMPLE_ROWS vectors of BUCKETS floats.
    """
    rows = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit("sample"), id_col).alias("h"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    most = max(1, min(SAMPLE_OF_LANGUAGE, SAMPLE_ROWS // len(counts)))
    # a first cut by hash leaves about twice what is wanted, the rank the rest
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, (2.0 * most + 50) / n))])
    drawn = rows.where(F.pmod("h", F.lit(1_000_003)) / 1_000_003.0 <= share[F.col("lang")])
    first = Window.partitionBy("lang").orderBy("h", "text")
    drawn = drawn.withColumn("k", F.row_number().over(first)).where(F.col("k") <= most).drop("k")

    def start():
        def one(lang, text, h):
            if has_letter(text):
                yield lang, h, features(text).tobytes()

        return one

    got = cut(map_rows(drawn, start, {"lang": "string", "h": "long", "x": "binary"}), "sample").orderBy("lang", "h", "x").collect()
    if not got:
        return None
    x, langs = np.empty((len(got), BUCKETS), np.float32), [r["lang"] for r in got]
    for i in range(len(got)):
        x[i] = np.frombuffer(got[i]["x"], np.float32)
        got[i] = None
    return Hierarchy(x, langs, families or FAMILIES)


def with_language(docs: DataFrame, model: Hierarchy | None, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct column ``out`` (lang_pred, score). No letter, a null text or no model give ``und``, 0."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts):
        import pandas as pd

        found = [(UNKNOWN, 0.0) if model is None else model.predict(t) for t in texts]
        return pd.DataFrame(found, columns=["lang_pred", "score"])

    return docs.withColumn(out, predict(F.col(text_col)))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    Texts without a letter, null ones too, give ``und``. A row with a null id is not held out and not learned
    from; null labels are not learned from. Repeated rows give repeated results, whole texts are read, other
    columns are not; with no labelled row every text is ``und``; empty in, empty out.
    """
    model = fit(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = with_language(rows, model, "text", "p")
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "p.lang_pred", "p.score")


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose text has a language with a score of ``least`` or more, with all their columns.

    Null texts and texts without a letter go; null labels and null ids stay if the text has a language, repeated rows stay
    or go together. With no labelled row to learn from every row goes; empty in, empty out. A column named _language is
    replaced.
    """
    model = fit(docs, id_col, text_col, lang_col)
    marked = with_language(docs, model, text_col, "_language")
    return marked.where((F.col("_language.lang_pred") != UNKNOWN) & (F.col("_language.score") >= least)).drop("_language")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op8_language": op8_language}
ORACLE_SQL: dict[str, str] = {}
