"""Encoding whole texts with public vocabularies, one cached piece at a time.

Text is cut only at places where every tokenizer used here provably starts a new pre-token, so the ids of a text
are the ids of its pieces in a row. Pieces repeat a lot; each worker keeps those it has encoded, up to a limit.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

#: Unicode White_Space (fixed values).
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_SPACED = tuple(w + " " for w in WHITE_SPACE)
_RUNS = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
#: Marks that may follow a word.
PUNCTUATION = ".,;:!?|"
#: Encoded pieces in each of a worker's two generations, and the longest piece worth keeping.
CACHED_PIECES, CACHED_CHARS = 500_000, 48
#: The same where words are encoded without the cache, so only marks, numbers and the like are kept.
CACHED_MARKS = 50_000
#: A longer run of white space, or of anything else, is left to the library.
UNCUT = 100_000
#: Bytes of texts that are cut together.
SPAN_BYTES = 1 << 21

#: By byte of UTF-8, where 0xC3 leads all that is not ASCII: whether its text may be cut by bytes (the rest of U+00D7 and
#: U+00F7 stands for no letter); its lower case; its kind: 0 white space, 1 anything else, 2 letter, 3 apostrophe.
_BYTES = np.arange(256, dtype=np.uint8)
_PLAIN = np.isin(_BYTES, [9, 10, 13, *range(32, 127), *range(0x80, 0xC0), 0xC3]) & ~np.isin(_BYTES, [0x97, 0xB7])
_LOWER = _BYTES + np.where(np.isin(_BYTES, [*range(65, 91), *range(0x80, 0x9F)]), 32, 0).astype(np.uint8)
_KIND = np.where(np.isin(_BYTES, [9, 10, 13, 32]), 0, np.where(np.isin(_BYTES, [*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3]), 2, 1)).astype(np.uint8)
_KIND[39] = 3
#: Whether a piece begins at a byte, by 4 times the kind of the byte before, plus its own. Bare: words and marks without
#: white space. Spaced: a run of white space belongs to what follows; an apostrophe may belong to the letters behind it.
_BARE_CUTS = np.array([0, 1, 1, 1, 0, 0, 0, 0, 0, 1, 0, 1, 0, 0, 0, 0], bool)
_SPACED_CUTS = np.array([0, 0, 0, 0, 1, 0, 1, 0, 1, 1, 0, 1, 1, 0, 0, 0], bool)


def spaced_pieces(text: str) -> list[str]:
    """Pieces that each start with a run of white space (the first perhaps without).

    For a byte-level vocabulary whose pattern is ``public_tokenizers.PATTERN``: a match that holds a non-space
    holds white space only as one leading space, so a match always begins where white space follows non-space.
    """
    if any(w in text for w in _SPACED):
        return _RUNS.findall(text)
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]]


def bare_pieces(text: str) -> list[str]:
    """Pieces between spaces and line ends, for a vocabulary that drops white space."""
    return text.replace("\n", " ").split(" ")


class PieceCache:
    """``each(pieces)``: the little-endian unsigned 32-bit ids of every piece, as bytes; ``encode`` joins them.

    encode_new: gives the ids (as bytes) of each of a list of strings. fold: a change of a string that leaves its ids alone.
    A new piece that ends in punctuation after a letter is looked up in two parts, since a pre-token starts there.
    The cache has two generations; what is used again moves to the younger one when it would be forgotten.
    """

    def __init__(self, encode_new: Callable[[list[str]], Iterable[bytes]], fold: Callable[[str], str] = str, limit: int = CACHED_PIECES):
        self.encode_new, self.fold, self.limit = encode_new, fold, limit
        self.young, self.old = {"": b""}, {}

    def encode(self, pieces: list[str]) -> bytes:
        return b"".join(self.each(pieces))

    def each(self, pieces: list[str]) -> list[bytes]:
        young, old = self.young, self.old
        out = list(map(young.get, pieces))
        if None not in out:
            return out
        gaps = [k for k, ids in enumerate(out) if ids is None]
        long, parts = {}, {}
        for p in {pieces[k] for k in gaps}:
            if (ids := old.get(p)) is not None:
                young[p] = ids
                continue
            body = p.rstrip(PUNCTUATION)
            if body == p or not body or not body[-1].isalpha():
                body = p
            parts[p] = (self.fold(body), p[len(body) :])
        wanted = {x for both in parts.values() for x in both if x not in young}
        for x in [x for x in wanted if x in old]:
            young[x] = old[x]
            wanted.discard(x)
        new = list(wanted)
        for x, ids in zip(new, self.encode_new(new), strict=True):
            (young if len(x) <= CACHED_CHARS else long)[x] = ids
        for p, (body, tail) in parts.items():
            if body != p:
                ids = (long if body in long else young)[body] + (long if tail in long else young)[tail]
                (young if len(p) <= CACHED_CHARS else long)[p] = ids
        for k in gaps:
            p = pieces[k]
            out[k] = long[p] if p in long else young[p]
        if len(young) > self.limit:
            self.young, self.old = {"": b""}, young
        return out

    def each_cut(self, pieces: list[str]) -> list[bytes]:
        """``each`` for pieces that differ, are folded and need no second cut."""
        out = list(map(self.young.get, pieces))
        gaps = [k for k, ids in enumerate(out) if ids is None]
        names = [pieces[k] for k in gaps]
        found = list(map(self.old.get, names))
        made = iter(self.encode_new([p for p, ids in zip(names, found, strict=True) if ids is None]))
        for k, p, ids in zip(gaps, names, found, strict=True):
            out[k] = ids = next(made) if ids is None else ids
            if len(p) <= CACHED_CHARS:
                self.young[p] = ids
        if len(self.young) > self.limit:
            self.young, self.old = {"": b""}, self.young
        return out


def folded(text: str) -> str:
    """For vocabularies that compose and lower-case: Latin-1 letters need no library for that."""
    return text.lower() if max(text, default="") <= "\xff" else text


class Words:
    """The merges of a ``tokenizers`` file, run by the byte-pair engine of ``tiktoken``, for words of Latin-1
    letters. A merge's rank stands for the pair; an end-of-word mark is a byte that UTF-8 never has, joined to its
    letter before all else."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        printable = [b for b in range(256) if chr(b).isprintable() and b not in (32, 0xAD)]
        rest = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(rest)}
        mark = model.get("end_of_word_suffix") or None

        def raw(token: str) -> bytes:
            ended = bool(mark) and token.endswith(mark)
            return bytes(byte_of[c] for c in (token[: -len(mark)] if ended else token)) + b"\xff" * ended

        ranks = {bytes([b]): b for b in range(256)}
        for b in range(256) if mark else ():
            ranks[bytes([b, 255])] = len(ranks)
        for m in model["merges"]:
            both = b"".join(raw(t) for t in (m.split(" ") if isinstance(m, str) else m))
            ranks.setdefault(both, len(ranks))
        ids = {raw(t): i for t, i in model["vocab"].items() if all(c in byte_of for c in (t[: -len(mark)] if mark and t.endswith(mark) else t))}
        self.ids = np.array([ids.get(b, -1) for b in sorted(ranks, key=ranks.get)])
        self.sizes = np.array([len(b) for b in sorted(ranks, key=ranks.get)])
        self.engine = tiktoken.Encoding("merges", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.ranks_of = self.engine._core_bpe.encode_single_piece
        self.end = b"\xff" if mark else b""
        self.knows = re.compile("[a-zªµºß-öø-ÿ]+" if mark else " ?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+").fullmatch

    def encode(self, words: list[str]) -> Iterator[bytes]:
        ranks = [self.ranks_of(w.encode() + self.end) for w in words]
        ids = self.ids[np.fromiter(chain.from_iterable(ranks), np.int64)]
        if (ids < 0).any():
            raise ValueError("a merge of the vocabulary file gives no token")
        raw, at = ids.astype("<u4").tobytes(), 0
        for r in ranks:
            yield raw[at : at + 4 * len(r)]
            at += 4 * len(r)

    def encode_joined(self, words: pa.StringArray) -> pa.ListArray:
        """For a file without an end-of-word mark and words that each begin with a space: they are cut apart again in the
        engine, and the bytes of its tokens tell where each one ends."""
        _, where, raw = words.buffers()
        at = np.frombuffer(where, np.int32)[: len(words) + 1] if len(words) else np.zeros(1, np.int32)
        ranks = np.array(self.engine.encode_ordinary(raw.to_pybytes()[: at[-1]].decode() if at[-1] else ""), np.int64)
        ids = self.ids[ranks]
        if (ids < 0).any():
            raise ValueError("a merge of the vocabulary file gives no token")
        ends = np.searchsorted(np.cumsum(self.sizes[ranks]), at, "right")
        return pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(ids.astype("<u4")))


@lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    """A worker's engine for a file, made once."""
    return Words(path)


@lru_cache(maxsize=4)
def added_tokens(path: str) -> tuple[re.Pattern | None, dict[str, int]]:
    """A pattern for the added tokens of a ``tokenizers`` file (none: None), and their ids. Called as usual, the library
    cuts a text at them before all else."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f).get("added_tokens") or []
    if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in found):
        raise ValueError(f"{path} has added tokens that are not found as they stand")
    ids = {t["content"]: t["id"] for t in found}
    return (re.compile("|".join(map(re.escape, sorted(ids, key=len, reverse=True)))) if ids else None), ids


def around_added(path: str, encode: Callable[[str], bytes]) -> Callable[[str], bytes]:
    """``encode`` for whole texts: added tokens become their ids, and what lies between is encoded apart."""
    pattern, ids = added_tokens(path)
    raw = {t: i.to_bytes(4, "little") for t, i in ids.items()}
    common = os.path.commonprefix([*raw])

    def run(text: str) -> bytes:
        if common not in text or pattern is None or not pattern.search(text):
            return encode(text)
        out, at = [], 0
        for m in pattern.finditer(text):
            out += [encode(text[at : m.start()]), raw[m[0]]]
            at = m.end()
        return b"".join([*out, encode(text[at:])])

    return run


@lru_cache(maxsize=4)
def piece_encoder(path: str, pieces: Callable[[str], list[str]]) -> Callable[[str], bytes]:
    """The little-endian unsigned 32-bit ids of a whole text, as the library gives them; ``pieces`` cuts its words."""
    cache = library_cache(path)
    return around_added(path, lambda text: cache.encode(pieces(text)))


@lru_cache(maxsize=4)
def library_cache(path: str) -> PieceCache:
    """A worker's cache over a ``tokenizers`` file, kept from task to task. Plain words go through the file's merges
    (class Words), all else through the library. For pieces without added tokens; see ``around_added``."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok, words = Tokenizer.from_file(path), words_of(path)
    tok.encode_special_tokens = True  # a folded piece may look like an added token that the text does not have
    lowers = tok.encode("AbC").ids == tok.encode("abc").ids

    def encode_new(new):
        plain = [words.knows(x) is not None for x in new]
        rest = iter(tok.encode_batch_fast([x for x, known in zip(new, plain, strict=True) if not known], add_special_tokens=False))
        found = words.encode([x for x, known in zip(new, plain, strict=True) if known])
        return [next(found) if known else struct.pack(f"<{len(ids := next(rest).ids)}I", *ids) for known in plain]

    return PieceCache(encode_new, folded if lowers else str)


@lru_cache(maxsize=2)
def whole_encoder(path: str) -> Callable[[str], np.ndarray]:
    """For a byte-level file whose pattern is ``public_tokenizers.PATTERN``: the ids (unsigned 32-bit) of a whole
    text, by the file's merges. Stretches without a place to cut (``UNCUT`` characters) go through the library."""
    words = words_of(path)
    table, encode = words.ids.astype("<u4"), words.engine.encode_ordinary

    def part(text: str) -> bytes:
        if len(text) > UNCUT and any(len(m) > UNCUT for m in _RUNS.findall(text)):
            return library_cache(path).encode(spaced_pieces(text))
        return table[np.array(encode(text), np.int64)].tobytes()

    run = around_added(path, part)
    return lambda text: np.frombuffer(run(text), "<u4")


@lru_cache(maxsize=2)
def column_encoder(path: str, spaced: bool = False) -> Callable[[pa.Array], Iterator[np.ndarray]]:
    """The ids (unsigned 32-bit) of every text of an Arrow array of strings, as the library gives them (null: none), for a
    vocabulary that drops white space and whose pattern ends a run of letters where anything else follows; ``spaced``: for
    a byte-level file whose pattern is ``public_tokenizers.PATTERN``.

    Texts of printable ASCII, tabs, line ends and the letters from U+00C0 to U+00FF are cut together, by the classes of
    their bytes, at white space and behind letters (``spaced``: and where letters follow marks other than an apostrophe);
    each distinct piece among them is looked up once. Texts with other characters, with added tokens or of more than
    ``SPAN_BYTES`` are encoded one by one."""
    added = added_tokens(path)[0]
    if spaced:  # without the library, whose tables take a worker's memory
        single, words, cuts = whole_encoder(path), words_of(path), _SPACED_CUTS
        cache = PieceCache(lambda new: [single(x).tobytes() for x in new], limit=CACHED_MARKS)
    else:
        pieces_of, words, cuts, cache = piece_encoder(path, bare_pieces), None, _BARE_CUTS, library_cache(path)
        single = lambda text: np.frombuffer(pieces_of(text), "<u4")
    added = added and re.compile(added.pattern.encode())
    lower = _LOWER if cache.fold is folded else np.arange(256, dtype=np.uint8)

    def cached(pieces: pa.StringArray) -> pa.ListArray:
        ids = cache.each_cut(pieces.to_pylist())
        ends = np.cumsum([0, *map(len, ids)]) // 4
        return pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(np.frombuffer(b"".join(ids), "<u4")))

    def joined(pieces: pa.StringArray) -> pa.ListArray:
        """A space and letters: without the cache."""
        if not len(pieces):
            return cached(pieces)
        _, where, raw = pieces.buffers()
        at, data = np.frombuffer(where, np.int32)[: len(pieces) + 1], np.frombuffer(raw, np.uint8)
        second = np.minimum(at[:-1] + 1, at[-1] - 1)  # of a piece of one byte: the next one's first
        plain = (np.diff(at) > 1) & (data[at[:-1]] == 32) & (_KIND[data[second]] == 2)
        order = np.r_[np.flatnonzero(plain), np.flatnonzero(~plain)]
        k, place = int(plain.sum()), np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        sorted_pieces = pieces.take(pa.array(order))
        ids = pa.concat_arrays([words.encode_joined(sorted_pieces[:k]), cached(sorted_pieces[k:])])
        return ids.take(pa.array(place))

    def together(data: np.ndarray, at: np.ndarray, texts: pa.Array) -> list[np.ndarray]:
        odd = [np.flatnonzero(~_PLAIN[data])]
        if len(data) and data.max() > 0x7F:  # what follows a lead byte, and nothing else, must be the rest of a letter
            odd.append(np.flatnonzero((data[:-1] == 0xC3) != (data[1:] >> 6 == 2)))
        if added:
            odd.append(np.array([m.start() for m in added.finditer(data)], np.int64))
        apart = np.unique(np.searchsorted(at, np.concatenate(odd), "right") - 1)
        data, kind = lower[data], _KIND[data]
        kept, begins = np.ones(len(data), bool) if spaced else kind > 0, np.zeros(len(data), bool)
        begins[1:] = cuts[4 * kind[:-1] + kind[1:]]
        begins[at[:-1][np.diff(at) > 0]] = True
        for k in apart:
            kept[at[k] : at[k + 1]] = False
        begins &= kept
        first = np.searchsorted(np.flatnonzero(begins), at)
        chars, starts = data[kept], np.flatnonzero(begins[kept])
        offsets = np.r_[starts, len(chars)].astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(chars)).dictionary_encode()
        found = (joined if spaced else cached)(pieces.dictionary).take(pieces.indices)
        flat, bounds = found.values.to_numpy(), found.offsets.to_numpy()[first]
        out = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for k in apart.tolist():
            out[k] = single(texts[k].as_py())
        return out

    def run(texts: pa.Array) -> Iterator[np.ndarray]:
        texts = texts.cast(pa.large_string()).fill_null("")
        _, where, raw = texts.buffers()
        at = np.frombuffer(where, np.int64)[texts.offset :][: len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data, a = np.frombuffer(raw or b"", np.uint8), 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(at, at[a] + SPAN_BYTES, "right")) - 1)
            if at[b] - at[a] > SPAN_BYTES:
                yield single(texts[a].as_py())
            else:
                yield from together(data[at[a] : at[b]], at[a : b + 1] - at[a], texts[a:b])
            a = b

    return run


PA = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "string": pa.string(),
    "boolean": pa.bool_(),
    "binary": pa.binary(),
    "array<binary>": pa.list_(pa.binary()),
    "array<int>": pa.list_(pa.int32()),
    "array<long>": pa.list_(pa.int64()),
    "array<float>": pa.list_(pa.float32()),
    "array<double>": pa.list_(pa.float64()),
    "array<boolean>": pa.list_(pa.bool_()),
}


def row_values(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The values of each row of an Arrow batch."""
    for at in range(0, batch.num_rows, 256):
        yield from zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True)


def map_rows(
    df: DataFrame, start: Callable[[], Callable[..., Iterator[tuple]]], columns: dict[str, str], rows: int = 1000, values: Callable[[pa.RecordBatch], Iterable[tuple]] = row_values
) -> DataFrame:
    """Arrow-batched map: ``start()`` runs once in each task and gives a function from one row's values to the
    rows it makes, or that and a function for the rows at the task's end. ``columns``: names and types of what comes out. At most ``rows`` rows wait at a time.
    ``values`` gives the rows' values."""
    schema = pa.schema([(n, PA[t]) for n, t in columns.items()])

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def run(batches):
        f, last = made if isinstance(made := start(), tuple) else (made, tuple)
        out: list[tuple] = []
        for b in batches:
            for row in values(b):
                out.extend(f(*row))
                if len(out) >= rows:
                    yield batch(out)
                    out = []
        out.extend(last())
        if out:
            yield batch(out)

    return df.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in columns.items()))
