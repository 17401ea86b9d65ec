"""Quality rules: compression bands.

The zstandard ratio (compressed bytes over bytes) of a whole text and of each fixed chunk of it must lie between
limits that depend on the length: below, the text repeats itself; above, it is noise.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import map_rows

#: (from bytes, least ratio, greatest ratio). Short texts hardly compress, so their limits are wider; the greatest
#: ratios lie between those of prose and of base64 noise. Below 100 bytes the two are alike.
WHOLE_BANDS = (
    (0, 0.0, 9.0), (100, 0.30, 1.06), (112, 0.30, 1.00), (125, 0.30, 0.97), (150, 0.30, 0.93), (200, 0.27, 0.88), (250, 0.27, 0.85),
    (300, 0.27, 0.82), (400, 0.25, 0.79), (600, 0.25, 0.73), (1600, 0.22, 0.70), (6400, 0.20, 0.70),
)
#: The same for one chunk, and the share of chunks outside their band that rejects a text: one of up to ten does.
CHUNK_BYTES, CHUNK_SHARE = 4096, 0.1
CHUNK_BANDS = tuple((n, 0.0 if n < 400 else 0.20 if n < 1600 else 0.17, high) for n, _, high in WHOLE_BANDS)
LEVEL = 3
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, WINDOW_WORDS, MOST_REPEATED = 10, 5, 20


def band(bands: tuple, n: int) -> tuple[float, float]:
    return next((low, high) for least, low, high in reversed(bands) if n >= least)


def repeated_words(words: list) -> int:
    """Words that lie in a window of WINDOW_WORDS words found twice or more, the first place included."""
    windows = list(zip(*(words[i:] for i in range(WINDOW_WORDS)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen, n, upto = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            n += i + WINDOW_WORDS - max(upto, i)
            upto = i + WINDOW_WORDS
    return n


def in_bands(raw: bytes, compress) -> tuple[float | None, float, bool]:
    """Ratio of the whole (None for an empty text), share of chunks outside, verdict."""
    if not raw:
        return None, 0.0, True
    low, high = band(WHOLE_BANDS, len(raw))
    whole = len(compress(raw)) / len(raw)
    outside = chunks = 0
    for at in range(0, len(raw), CHUNK_BYTES):
        part = raw[at : at + CHUNK_BYTES]
        least, most = band(CHUNK_BANDS, len(part))
        chunks += 1
        outside += not least <= len(compress(part)) / len(part) <= most
    share = outside / chunks
    return whole, share, low <= whole <= high and share < CHUNK_SHARE


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, ratio, chunks_outside.

    A null text counts as no words: base_failed, not kept, ratio null. Repeated rows give repeated results, null
    ids pass through, other columns are not read, empty in, empty out. Very long texts are taken whole.
    """

    def start():
        import zstandard

        compress = zstandard.ZstdCompressor(level=LEVEL).compress

        def one(doc_id, text):
            text = text or ""
            raw = text.encode()
            words = raw.split()  # bytes split at the six ASCII white-space characters only
            lines = [line for line in raw.split(b"\n") if line.strip()]
            n, repeated = len(words), repeated_words(words)
            failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n
            ratio, outside, ok = in_bands(raw, compress)
            yield (
                doc_id, n, len(text) - sum(map(text.count, WHITE)), sum(raw.count(c) for c in SYMBOLS),
                len(lines) - len(set(lines)), repeated, failed, ok and not failed, ratio, outside,
            )

        return one

    columns = {c: "long" for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    columns |= {"base_failed": "boolean", "kept": "boolean", "ratio": "double", "chunks_outside": "double"}
    return map_rows(docs.select(F.col(id_col), F.col(text_col)), start, columns)


def op7_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


QUERIES = {"op7_compression_bands": op7_compression_bands}
ORACLE_SQL: dict[str, str] = {}
