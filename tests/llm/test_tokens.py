import base64
import collections
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
import zstandard
from tokenizers import Tokenizer

from edgewright.llm import bpe_tree, packing, token_store, tokens
from edgewright.llm.common import cut, shared_dir
from edgewright.llm.tokens import bare_pieces, piece_encoder, spaced_pieces, whole_encoder

ODD = ["", "a" * 5000, "ab" * 3000, " \n \t x  y\n", "\x1c a\x1c b  \x1c", "don't 'll  we've!!  ... 12 3a", " x", " ", "  ", "　a　 b", "é" * 700 + "́", "the" * 2000]
ODD += ["Ωσς ΑΣ", "µm ªº ß ÀÉ", "<|endoftext|> <|startoftext|>", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>y  <|startoftext|>\n", "<|EndOfText|> <|endoftext", "é<|startoftext|>É " * 50, "word. word, word|", "İstanbul ǅ", "\x85x\x85 y"]
DOCS = [(None, "x y"), (1, None), (2, ""), (3, "a b" * 4000), (3, "a b" * 4000), (4, " \n "), (5, "the " * 1023), (6, "x <|endoftext|> y")]


def texts():
    rng = random.Random(1)
    return ODD + ["".join(rng.choice("ab c\n\t'sé1! \x1c😀tion") for _ in range(rng.randint(0, 200))) for _ in range(1500)]


def ids_of(b):
    return list(struct.unpack(f"<{len(b) // 4}I", b))


@pytest.mark.parametrize(("name", "pieces"), [("word_bpe_49k.json", bare_pieces), ("byte_bpe_50k.json", spaced_pieces)])
def test_pieces_give_the_library_ids(name, pieces):
    tok, encode = Tokenizer.from_file(P.path(name)), piece_encoder(P.path(name), pieces)
    for t in texts():
        assert ids_of(encode(t)) == tok.encode(t, add_special_tokens=False).ids


def test_whole_texts_give_the_library_ids(monkeypatch):
    tok, encode = Tokenizer.from_file(P.path("byte_bpe_50k.json")), whole_encoder(P.path("byte_bpe_50k.json"))
    for uncut in (100_000, 50):
        monkeypatch.setattr("edgewright.llm.tokens.UNCUT", uncut)
        for t in texts():
            assert encode(t).tolist() == tok.encode(t, add_special_tokens=False).ids


PLAIN = ["Don't STOP, don't 'll 3a a3b!?b _x_ a-b", "Ünïcode ÀÉÿß Þþ ÷ × a×b", "x\ty\r\nz", "\x7fa\x00b", "É.é,É", "%%%. a%%%.b", "é", "", "a" * 60 + "." * 60, "ª µ º", "<|EndOfText|> A<|endoftext|>b"]


@pytest.mark.parametrize("span", [1 << 21, 300, 1])
def test_columns_give_the_library_ids(monkeypatch, span):
    monkeypatch.setattr(tokens, "SPAN_BYTES", span)
    rng = random.Random(2)
    some = PLAIN + texts() + ["".join(rng.choice("ab c\n\t.,'-E\u00c9\u00e93%s") for _ in range(rng.randint(0, 80))) for _ in range(500)]
    tok, encode = Tokenizer.from_file(P.path("word_bpe_49k.json")), tokens.column_encoder(P.path("word_bpe_49k.json"))
    column = pa.array([None, "before", *some, None, "", "after"])[2:-1]  # starts inside its buffers
    got = [x.tolist() for x in encode(column)]
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in some] + [[], []]
    for none in (column[:0], pa.array([None, ""], pa.string()), pa.array([], pa.large_string())):
        assert [len(x) for x in encode(none)] == [0] * len(none)


def test_a_piece_of_a_column_is_looked_up_once(monkeypatch):
    path, asked = P.path("word_bpe_49k.json"), []
    cache = tokens.library_cache(path)
    monkeypatch.setattr(cache, "each_cut", lambda pieces, real=cache.each_cut: asked.extend(pieces) or real(pieces))
    column = pa.array(["Word word, WORD.", None, "word.\n\u00c9t\u00e9 \u00e9t\u00e9, word"] * 50)
    assert len([*tokens.column_encoder(path)(column)]) == 150
    assert sorted(asked) == sorted(["word", ",", ".", "\u00e9t\u00e9"])


@pytest.mark.parametrize("span", [1 << 21, 300, 1])
def test_spaced_columns_give_the_library_ids(monkeypatch, span):
    monkeypatch.setattr(tokens, "SPAN_BYTES", span)
    rng = random.Random(4)
    odd = ["  lead", "trail  ", " ", "\n\n", "x\n\n y", "it's 'sup ''s !'s 3's 's'll", "a  b \n c\r\n\td", "<|endoftext|>", " a<|endoftext|> b", "a <|endoftex", " \u00e9", "x " + "a" * 700, "\u2003a \u00a0b"]
    some = odd + PLAIN + texts() + ["".join(rng.choice("abst  \n\t.,''-E\u00c9\u00e93%") for _ in range(rng.randint(0, 80))) for _ in range(2000)]
    tok, encode = Tokenizer.from_file(P.path("byte_bpe_50k.json")), tokens.column_encoder(P.path("byte_bpe_50k.json"), spaced=True)
    column = pa.array([None, "before", *some, None, "", "after"])[2:-1]  # starts inside its buffers
    got = [x.tolist() for x in encode(column)]
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in some] + [[], []]
    for none in (column[:0], pa.array([None, ""], pa.string()), pa.array([], pa.large_string())):
        assert [len(x) for x in encode(none)] == [0] * len(none)


def test_packing_encodes_a_word_of_a_batch_once(monkeypatch, spark):
    asked, joined = [], tokens.Words.encode_joined
    monkeypatch.setattr(tokens.Words, "encode_joined", lambda self, words: asked.extend(words.to_pylist()) or joined(self, words))
    monkeypatch.setattr(packing, "map_rows", lambda docs, start, columns, rows, values: values)
    values = packing.left_overs(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", P.path("byte_bpe_50k.json"), 0, 1024, False)
    batch = pa.RecordBatch.from_pydict({"doc_id": range(150), "text": ["One word, one word.", None, "a word\n \u00c9t\u00e9 and one word"] * 50})
    assert [len(ids) for _, ids in values(batch)][1] == 0
    assert sorted(asked) == sorted([" word", " one", " and"])


def test_a_small_cache_forgets_and_finds_again():
    made = []
    cache = tokens.PieceCache(lambda new: [made.append(x) or x.encode() for x in new], limit=3)
    for pieces in (["a", "b"], ["c", "d"], ["a", "e"], ["x" * 99, "a"], ["f", "g"], ["x" * 99]):
        assert cache.each_cut(pieces) == [p.encode() for p in pieces]
        assert len(cache.young) <= 6 and "x" * 99 not in cache.young
    assert made.count("a") == 1 and made.count("x" * 99) == 2


def encoder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe_tree.VOCABULARY), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize(("leaf", "long_window"), [(64, 256), (32, 64), (7, 0), (3, 8), (1, 2), (1, 0)])
def test_tree_joins_give_the_library_ids(leaf, long_window):
    enc, tree = encoder(), bpe_tree.TreeBPE(P.path(bpe_tree.VOCABULARY), leaf=leaf, long_window=long_window)
    hard = ["é" * 3000 + " x", "'s't'll" * 900, "a'll b" * 500, "  \n" * 400 + "x", " " * 3000, "don't" * 300 + "'" * 300]
    for t in texts() + hard:
        want = enc.encode_ordinary(t)
        assert tree.encode(t) == want
        assert tree.decode(want) == t.encode()
    assert tree.joins > 1000
    assert tree.decode(list(range(200)) * 500) == b"".join(tree.bytes_of[:200]) * 500


def test_documents_go_through_joins():
    enc, tree = encoder(), bpe_tree.TreeBPE(P.path(bpe_tree.VOCABULARY))
    found = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()]
    long = sum(len(t) > 2 * tree.leaf for t in found)
    for t in found:
        before = tree.joins
        assert tree.encode(t) == enc.encode_ordinary(t)
        long -= len(t) > 2 * tree.leaf and tree.joins > before
    assert long <= 2 and tree.joins * 150 > sum(map(len, found))


def test_encode_documents(spark):
    enc = encoder()
    docs = spark.createDataFrame([(*r, 1, b"z", "q") for r in DOCS], "doc_id long, text string, ids long, decoded binary, n_tokens string")
    got = bpe_tree.encode_documents(docs).collect()
    assert collections.Counter((r.doc_id, tuple(ids_of(r.ids)), bytes(r.decoded)) for r in got) == collections.Counter((i, tuple(enc.encode_ordinary(t or "")), (t or "").encode()) for i, t in DOCS)
    assert bpe_tree.encode_documents(docs.limit(0), digest=True).count() == 0


def test_crc_and_cuts():
    assert token_store.crc_of_both(zlib.crc32(b"left"), zlib.crc32(b"right!"), 6) == zlib.crc32(b"leftright!")
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 49_000, 60_000).astype("<u4")
    ends = token_store.cut_points(ids)
    assert ends[-1] == len(ids) and max(np.diff([0, *ends])) <= token_store.MOST
    moved = token_store.cut_points(np.r_[ids[:777], ids])
    assert len(set(np.array(moved) - 777) & set(ends)) > 0.8 * len(ends)
    assert token_store.cut_points(ids[:0]) == []


def library_ids(name, end, t):
    tok = Tokenizer.from_file(P.path(name))
    return np.array([*tok.encode(t or "", add_special_tokens=False).ids, end], "<u4")


def test_token_store_round_trip(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("doc_id > 20"))
    path = f"{shared_dir(spark)}/tokens"
    token_store.write_store(docs, path)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    want = collections.Counter()
    ids = {}
    for r in rows:
        x = library_ids("word_bpe_49k.json", 2, r.text)
        want[(r.doc_id, len(x), zlib.crc32(x.tobytes()))] += 1
        ids.setdefault(r.doc_id, []).append(x.tolist())
    got = sorted(token_store.read_digests(spark, path).collect(), key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert all(r.ids in ids[r.doc_id] for r in token_store.read_documents(spark, path).collect())
    stored = spark.read.parquet(f"{path}/documents").selectExpr("explode(chunks) c", "size(elsewhere) e").count()
    own = spark.read.parquet(f"{path}/documents").selectExpr("sum(size(chunks) - size(elsewhere))").first()[0]
    assert own == spark.read.parquet(f"{path}/documents").selectExpr("explode(chunks) c").distinct().count() < stored


def test_token_store_empty(spark):
    path = f"{shared_dir(spark)}/tokens"
    token_store.write_store(spark.createDataFrame([], "doc_id long, text string"), path)
    assert token_store.read_digests(spark, path).count() == 0


def damaged(spark, path, table, change):
    """A copy of the store in which one table's rows are changed."""
    to = f"{shared_dir(spark)}/tokens"
    for name in ("documents", "index", "manifest"):
        df = spark.read.parquet(f"{path}/{name}")
        if name == table:
            df = spark.createDataFrame(change([r.asDict() for r in df.collect()]), df.schema)
        df.write.parquet(f"{to}/{name}")
    return to


def test_damaged_stores_are_noticed(spark):
    rng = random.Random(3)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randrange(99)) for _ in range(9000))
    docs = spark.createDataFrame([(1, long, "c"), (2, long + " more", "c"), (3, None, "c"), (None, "x " + long, "c")], "doc_id long, text string, chunks string")
    path = f"{shared_dir(spark)}/tokens"
    token_store.write_store(docs, path)
    assert token_store.read_digests(spark, path).count() == 4

    def edit(k, v):
        def change(rows):
            i = next(i for i, r in enumerate(rows) if r["doc_id"] == 1)
            rows[i][k] = v(rows[i])
            return rows

        return change

    def repacked(r):
        ids = token_store.unpacked(r["blob"], zstandard.ZstdDecompressor().decompress).copy()
        ids[len(ids) // 2] ^= 1
        return token_store.packed(ids, zstandard.ZstdCompressor().compress)

    owner = next(r for r in spark.read.parquet(f"{path}/documents").collect() if not r["elsewhere"] and len(r["chunks"]) > 3)

    def lost(rows):  # the owner says that its first chunk is stored elsewhere
        r = next(r for r in rows if r["doc_id"] == owner["doc_id"])
        ids = token_store.unpacked(r["blob"], zstandard.ZstdDecompressor().decompress)
        r["elsewhere"], r["blob"] = [0], token_store.packed(ids[r["lens"][0] :], zstandard.ZstdCompressor().compress)
        return rows

    cases = [
        ("documents", edit("chunks", lambda r: [b"z" * 16, *r["chunks"][1:]]), "root"), ("documents", edit("root", lambda r: b"z" * 16), "manifest"),
        ("documents", lambda rows: rows[1:], "manifest"), ("index", edit("root", lambda r: b"z" * 16), "index"), ("index", lambda rows: rows[1:], "index"),
        ("documents", lambda rows: [r if r["doc_id"] != owner["doc_id"] else r | {"blob": repacked(r)} for r in rows], "address"), ("documents", lost, "is lost"),
        ("manifest", lambda rows: rows[1:], "manifest"),
    ]
    for table, change, what in cases:
        with pytest.raises(Exception, match=what):
            token_store.read_digests(spark, damaged(spark, path, table, change)).collect()


def test_packing(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").where("doc_id <> 3").union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("doc_id > 20"))
    got = packing.pack(docs, shard_docs=100, with_ids=True).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for r in docs.collect():
        ids, at = library_ids("byte_bpe_50k.json", 0, r.text), 0
        for p in sorted(by_doc[r.doc_id], key=lambda p: p.start):
            raw = ids[p.start : p.start + p.length].tobytes()
            assert (p.start, p.doc_tokens, p.ids_crc32, bytes(p.ids)) == (at, len(ids), zlib.crc32(raw), raw)
            at += p.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 1024
    short = [s for s in by_sequence.values() if sum(p.length for p in s) < 1024]
    assert len(short) <= 4  # the last one of each shard
    assert packing.pack(docs.limit(0)).count() == 0


def test_bm25_neighbours_come_first():
    rng = np.random.default_rng(3)
    topic = [rng.integers(1000 * k, 1000 * k + 40, 300).astype("<u4") for k in (1, 2, 1, 2, 3, 3, 4, 4)]
    pieces = packing.fill(topic, 600)
    pairs = collections.defaultdict(set)
    for doc, _, _, sequence, _ in pieces:
        pairs[sequence].add(doc)
    assert pairs[0] == {0, 2} and pairs[1] == {1, 3}
    index = packing.ShardIndex(topic)
    assert index.scores(0).argsort()[::-1][:2].tolist() in ([0, 2], [2, 0])


def test_hot_groups_are_searched():
    rng = np.random.default_rng(5)
    copy = rng.integers(0, 500, 100).astype("<u4")
    texts = [copy if k % 3 == 0 else rng.integers(500, 3000, 100).astype("<u4") for k in range(90)]
    scores = packing.ShardIndex(texts).scores(0)
    assert min(scores[::3]) > 0 and not scores[1::3].any() and not scores[2::3].any()
    first = [doc for doc, _, _, sequence, _ in packing.fill(texts, 1000) if sequence == 0]
    assert len(first) == 10 and all(doc % 3 == 0 for doc in first)
    few = [copy[:50]] * 3 + [rng.integers(500, 3000, 50).astype("<u4") for _ in range(3)]
    assert all(packing.ShardIndex(few).scores(0)[:3] > 0)


def plain_scores(texts, i):
    n, terms = len(texts), [collections.Counter(x.tolist()) for x in texts]
    mean = sum(map(len, texts)) / n
    df = collections.Counter(t for x in terms for t in x)
    idf = {t: np.log1p((n - f + 0.5) / (f + 0.5)) for t, f in df.items()}
    return [sum(idf[t] * x[t] * 2.2 / (x[t] + 1.2 * (0.25 + 0.75 * len(y) / mean)) for t in terms[i] if t in x) for x, y in zip(terms, texts, strict=True)]


def test_scores_are_bm25_over_all_terms():
    rng = np.random.default_rng(6)
    texts = [np.minimum(rng.geometric(0.05, rng.integers(1, 200)), 300).astype("<u4") for _ in range(60)]
    index = packing.ShardIndex(texts)
    for i in range(60):
        assert np.allclose(index.scores(i), plain_scores(texts, i), rtol=1e-5)
    index.keep(np.arange(60) % 4 == 0)
    assert np.allclose(index.scores(3), plain_scores(texts, 3)[::4], rtol=1e-5)


def test_long_documents_are_found_by_their_whole_text(spark):
    words = [["red", "blue", "green", "white"], ["cat", "dog", "horse", "cow"], ["tin", "iron", "copper", "lead"]]
    texts = [" ".join(random.Random(k).choices(words[k % 3], k=950)) for k in range(30)]
    docs = spark.createDataFrame([(k, t + " end of the text" * 90) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    tails = collections.defaultdict(set)
    got = packing.pack(docs).where("length < 1024").collect()
    for r in got:
        tails[r.sequence_id].add(r.doc_id)
    full = [x for x in tails.values() if len(x) > 1]
    same = sum(len({d % 3 for d in x}) == 1 for x in full)
    assert len(full) > 8 and same >= len(full) - 4


def test_statistics_cover_all_and_copies_meet(spark):
    rng = random.Random(8)
    words = [a + b + c for a in "bdfgk" for b in "aeiou" for c in ("lor", "min", "tas", "vek", "zun", "pir")]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(300)]
    docs = spark.createDataFrame([(k % 300, texts[k % 300]) for k in range(600)] + [(1000, texts[0])] * 150, "doc_id long, text string").repartition(3)
    staged = cut(packing.left_overs(docs, "doc_id", "text", P.path("byte_bpe_50k.json"), 0, 1024, False), "left_overs")
    corpus = packing.corpus_of(staged)
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = [np.array([*tok.encode(r.text).ids, 0]) for r in docs.collect()]
    assert corpus.n == 750 and corpus.mean == sum(map(len, ids)) / 750
    df = np.bincount(np.concatenate([np.unique(x) for x in ids]))
    assert corpus.df.tolist() == df.tolist()
    got = packing.dealt(staged, corpus, 100).collect()
    sizes = collections.Counter(r.shard for r in got)
    assert len(sizes) == 8 and max(sizes.values()) < 150
    shards = collections.defaultdict(set)
    for r in got:
        shards[r.doc_id].add(r.shard)
    assert sum(len(shards[k]) == 1 for k in range(1, 300)) > 285 and len(shards[1000]) <= 3
