"""Byte-level BPE as a monoid: a text is halved down to small leaves, and the halves' ids are joined up the tree.

Let E(x) be the encoding of x. A cut falls anywhere, also inside a word, so E(x + y) is E(x) and E(y) but for a window
around the cut, which is encoded again. The window grows until what lies outside is proven final:

* Every match of the pattern begins where white space follows something else, whatever stands before or after. So the
  window grows to the nearest such place on either side; tokens beyond it are those of the halves.
* In a long stretch without such a place, the one match that crosses the cut is joined token by token. A token sequence
  is E of its bytes if and only if each pair of neighbours (s, t) is stable, that is E(s + t) = (s, t): the first merge
  that crossed a token boundary would also be the lowest-ranked merge, leftmost on ties, in the two tokens alone. The
  window doubles until its first and last token are stable against those outside.

Decoding is the homomorphism back: the bytes of leaves of ids, concatenated up a tree.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import WHITE_SPACE, map_rows

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Characters of a leaf of text and ids of a leaf of tokens.
LEAF = 64
#: A window of more characters than this is joined token by token.
LONG_WINDOW = 256
#: Encoded windows that a worker keeps for other texts.
KEPT_WINDOWS = 500_000


class TreeBPE:
    """Encoder and decoder over a file of ranks. leaf: the longest text (characters) and the most ids that are encoded or
    decoded at once. ``joins``: how many joins have encoded a window again."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, leaf: int = LEAF, long_window: int = LONG_WINDOW):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        engine = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.short, self.merged = engine.encode_ordinary, engine.encode_single_piece
        self.matches = regex.compile(pattern).findall
        self.leaf, self.long_window, self.joins = leaf, long_window, 0
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.bytes_of[i] = b
        self.stable = lru_cache(100_000)(lambda s, t: self.merged(self.bytes_of[s] + self.bytes_of[t]) == [s, t])
        self.windows: dict[str, list[int]] = {}

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text, by its tree."""
        if len(self.windows) > KEPT_WINDOWS:
            self.windows.clear()
        return self._node(text, 0, len(text))

    def _node(self, text: str, a: int, b: int) -> list[int]:
        if b - a <= self.leaf:
            return self.short(text[a:b])
        cut = (a + b) // 2
        return self.join(text, a, cut, b, self._node(text, a, cut), self._node(text, cut, b))

    def join(self, text: str, a: int, cut: int, b: int, left: list[int], right: list[int]) -> list[int]:
        """E(text[a:b]) from E(text[a:cut]) and E(text[cut:b])."""
        p, q = self._begin(text, a, cut), self._end(text, cut, b)
        if q == cut:
            return left + right
        self.joins += 1
        if q - p > self.long_window:
            return self._long_join(text, p, cut, q, left, right)
        return left[: len(left) - len(self._window(text[p:cut]))] + self._window(text[p:q]) + right[len(self._window(text[cut:q])) :]

    def _window(self, part: str) -> list[int]:
        ids = self.windows.get(part)
        if ids is None:
            ids = self.windows[part] = self.short(part)
        return ids

    @staticmethod
    def _begin(text: str, a: int, cut: int) -> int:
        """The last place in (a, cut) where a space follows something else; a if there is none."""
        while (at := text.rfind(" ", a + 1, cut)) > 0:
            if text[at - 1] not in WHITE_SPACE:
                return at
            cut = at
        return a

    @staticmethod
    def _end(text: str, cut: int, b: int) -> int:
        """The first place in [cut, b) where a space follows something else; b if there is none."""
        at = cut - 1
        while (at := text.find(" ", at + 1, b)) >= 0:
            if text[at - 1] not in WHITE_SPACE:
                return at
        return b

    def _long_join(self, text: str, p: int, cut: int, q: int, left: list[int], right: list[int]) -> list[int]:
        """The same for a long stretch [p, q): matches that both sides already have stay, and one that crosses the cut
        is joined token by token."""
        ours, theirs, both = self.matches(text[p:cut]), self.matches(text[cut:q]), self.matches(text[p:q])
        same = next((k for k, (x, y) in enumerate(zip(ours, both, strict=False)) if x != y), min(len(ours), len(both)))
        most = min(len(theirs), len(both) - same)
        after = next((k for k in range(most) if theirs[-1 - k] != both[-1 - k]), most)
        x, y, middle = ours[same:], theirs[: len(theirs) - after], both[same : len(both) - after]
        i = len(left) - self._count(reversed(left), x)
        j = self._count(right, y)
        if len(x) == len(y) == len(middle) == 1:
            new = self.join_tokens(left[i:], right[:j])
        else:
            new = [t for m in middle for t in self.merged(m.encode())]
        return left[:i] + new + right[j:]

    def _count(self, ids, matches: list[str]) -> int:
        """How many of the first ids make up the bytes of the matches."""
        rest, n = sum(len(m.encode()) for m in matches), 0
        for t in ids if rest else ():
            rest, n = rest - len(self.bytes_of[t]), n + 1
            if rest <= 0:
                break
        return n

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of a match from those of its two parts."""
        i = j = 1
        while True:
            window = self.merged(b"".join(self.bytes_of[t] for t in left[-i:] + right[:j]))
            left_ok = i >= len(left) or self.stable(left[-i - 1], window[0])
            right_ok = j >= len(right) or self.stable(window[-1], right[j])
            if left_ok and right_ok:
                return left[:-i] + window + right[j:]
            i = i if left_ok else min(len(left), 2 * i)
            j = j if right_ok else min(len(right), 2 * j)

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids: those of leaves, then of pairs of neighbours up to the root."""
        get, leaf = self.bytes_of.__getitem__, self.leaf
        level = [b"".join(map(get, ids[k : k + leaf])) for k in range(0, len(ids), leaf)]
        while len(level) > 1:
            odd = level[-1:] * (len(level) % 2)
            level = [x + y for x, y in zip(level[::2], level[1::2], strict=False)] + odd
        return level[0] if level else b""


@lru_cache(maxsize=2)
def _worker(path: str) -> TreeBPE:
    """A worker's encoder, kept from task to task."""
    return TreeBPE(path)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, digest: bool = False) -> DataFrame:
    """One row per input row: doc_id, ids (little-endian unsigned 32-bit, binary), decoded (binary); with
    ``digest`` instead doc_id, n_tokens, ids_sha256, decoded_sha256 of the same values, hashed where they arise.

    A null text counts as empty and gives no ids; repeated rows give repeated results; null ids pass through;
    other columns are not read; an empty table gives an empty result. Long texts stay in one row.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def start():
        bpe = _worker(path)

        def one(doc_id, text):
            ids = bpe.encode(text or "")
            raw, back = np.array(ids, "<u4").tobytes(), bpe.decode(ids)
            if digest:
                yield doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back).hexdigest()
            else:
                yield doc_id, raw, back

        return one

    columns = {"ids": "binary", "decoded": "binary"}
    if digest:
        columns = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    return map_rows(docs.select(F.col(id_col), F.col(text_col)), start, {"doc_id": "long"} | columns, 200)


def op10_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), digest=True)


QUERIES = {"op10_bpe_tree": op10_bpe_tree}
ORACLE_SQL: dict[str, str] = {}
