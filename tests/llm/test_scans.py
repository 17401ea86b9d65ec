import collections
import random
import re

import pytest

import corpus_pipeline
from edgewright.llm import chat, language, license_scan, quality
from edgewright.llm.common import cut

DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"
MIT = license_scan.TEMPLATES[0][0].split()
ODD = [
    (1, "Under the MIT license. under THE mit\nlicense"), (2, "Apache License, Version 2.0; cc by nc cc-by-nc"), (3, None), (4, ""), (5, "the mit"), (6, " ".join(MIT)),
    (7, "x " + " ".join([*MIT[:20], "extra", *MIT[20:]])), (8, " ".join(MIT[:10])), (9, "under the mit license " * 3000), (10, "cc by nc"), (10, "cc by nc"), (None, "cc by nc"), (10, "other"), (11, "ÉKunder the mit license"),
]


def odd_docs(spark):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in ODD], "doc_id long, text string, words string, h long, label long")


def test_licenses(spark):
    got = collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.license_labels(odd_docs(spark)).collect())
    want = collections.Counter()
    for i, t in ODD:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        at = [(k, label) for words, label in license_scan.PHRASES for k in range(len(w)) if w[k : k + len(words.split())] == words.split()]
        places = [k for k, _ in at]
        want[(i, len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at})))] += 1
    assert got == want
    by_id = {r.doc_id: r for r in license_scan.license_labels(odd_docs(spark)).collect()}
    assert by_id[6].labels == "mit" and by_id[6].score == 1.0 and by_id[7].labels == "mit" and 0.8 <= by_id[7].score < 1
    assert by_id[8].labels == "" and by_id[5].score == 0 and by_id[11].labels == ""
    assert license_scan.license_labels(odd_docs(spark).limit(0)).count() == 0


def test_license_spans_cover_the_words(spark):
    _, spans = license_scan.scan(odd_docs(spark))
    found = {(r.doc_id, r.label): (r.first_word, r.last_word) for r in spans.where("NOT phrase").collect()}
    assert found[(6, "mit")] == (0, len(MIT) - 1) and found[(7, "mit")] == (1, len(MIT) + 1)


def brute_labels(t):
    """Labels and score by aligning every word of the text with every word of a template."""
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    found = {(label, 1.0) for words, label in license_scan.PHRASES for k in range(len(w)) if w[k : k + len(words.split())] == words.split()}
    for words, label in license_scan.TEMPLATES:
        x = words.split()
        hits = [(i - p, p) for i in range(len(w) - 2) for p in range(len(x) - 2) if w[i : i + 3] == x[p : p + 3]]
        for d in {d for d, _ in hits}:
            places = {p for e, p in hits if abs(d - e) <= license_scan.BAND}
            if len({p + o for p in places for o in range(3)}) >= license_scan.LEAST_COVERAGE * len(x):
                found.add((label, len(places) / (len(x) - 2)))
    return ",".join(sorted({x for x, _ in found})), max((s for _, s in found), default=0.0)


def test_license_labels_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(100, "the license you may y " * 12), (101, "of the software x " * 40), (102, " ".join(MIT[::-1])), (103, " ".join(MIT * 3)), (104, " ".join(MIT[:25]) + " and more " * 9 + " ".join(MIT[25:]))]
    for n, (words, _) in enumerate(license_scan.TEMPLATES):
        w = words.split()
        for k in range(12):
            i = rng.randrange(len(w))
            edit = [w[:i] + ["changed"] + w[i + 1 :], w[:i] + ["more"] + w[i:], w[:i] + w[i + 1 :], w[i:] + w[:i], w[: len(w) * k // 12], rng.sample(w, len(w))][k % 6]
            rows.append((200 + 100 * n + k, "some text " * rng.randrange(3) + " ".join(edit) + " tail"))
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.license_labels(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for i, t in rows:
        labels, score = brute_labels(t)
        assert got[i][0] == labels and abs(got[i][1] - score) < 1e-12, (i, t)
    assert got[100] == got[101] == got[102] == ("", 0.0)


def test_one_edit_inside_a_template_is_found(spark):
    rows = []
    for n, (words, _) in enumerate(license_scan.TEMPLATES):
        w = words.split()
        for i in range(3, len(w) - 3):
            rows += [(1000 * n + 10 * i + e, " ".join(x)) for e, x in enumerate((w[:i] + ["changed"] + w[i + 1 :], w[:i] + ["more"] + w[i:], w[:i] + w[i + 1 :]))]
    got = license_scan.license_labels(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(license_scan.TEMPLATES[r.doc_id // 1000][1] in r.labels.split(",") for r in got)


def brute_quality(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = collections.Counter(windows)
    repeated = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(repeated), len(w) < 10 or 100 * len(repeated) > 20 * len(w)


def test_quality(spark):
    docs = spark.read.parquet(DOCUMENTS).select("doc_id", "text").union(odd_docs(spark).select("doc_id", "text")).union(spark.createDataFrame([(900, "a b\x1c c\x85"), (901, "#\n#\n \n\n#")], "doc_id long, text string"))
    rows = docs.collect()
    got = collections.Counter(tuple(r)[:7] for r in quality.quality(docs).collect())
    assert got == collections.Counter((r.doc_id, *brute_quality(r.text)) for r in rows)
    assert quality.quality(docs.limit(0)).count() == 0


def brute_verdict(t):
    """kept, ratio and the share of chunks outside, by reading the tables of limits from the top."""
    import zstandard

    raw, size = (t or "").encode(), lambda b: len(zstandard.ZstdCompressor(level=3).compress(b)) / len(b)

    def inside(bands, b):
        for least, low, high in bands:
            if len(b) >= least:
                found = low <= size(b) <= high
        return found

    if not raw:
        return False, None, 0.0
    chunks = [raw[i : i + 4096] for i in range(0, len(raw), 4096)]
    outside = sum(not inside(quality.CHUNK_BANDS, c) for c in chunks) / len(chunks)
    return inside(quality.WHOLE_BANDS, raw) and outside < 0.1 and not brute_quality(t)[-1], size(raw), outside


def test_kept_against_brute_force(spark):
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    noise = lambda n: " ".join("".join(rng.choice(letters) for _ in range(10)) for _ in range(n // 11 + 1))[:n]
    prose = [r.text for r in spark.read.parquet(DOCUMENTS).collect() if r.text]
    rows = [noise(n) for n in (60, 120, 180, 260, 350, 500, 900, 3000, 9000, 60_000)] + ["ab cd ef " * (n // 9) for n in (60, 120, 180, 260, 350, 500, 900, 3000, 9000)]
    rows += [(p * 40)[:20_000] + noise(4096 * k) for p in prose[:5] for k in (1, 3)] + prose + [None, "", "é " * 50_000]
    docs = spark.createDataFrame([(i, t, True, 0.5) for i, t in enumerate(rows)], "doc_id long, text string, kept boolean, ratio double")
    got = {r.doc_id: (r.kept, r.ratio, r.chunks_outside) for r in quality.quality(docs).collect()}
    assert got == {i: brute_verdict(t) for i, t in enumerate(rows)}
    assert not any(got[i][0] for i in range(1, 19))


def test_compression_bands():
    import os
    import random

    import zstandard

    compress = zstandard.ZstdCompressor(level=3).compress
    rng = random.Random(1)
    prose = " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "he"]) for _ in range(rng.randint(1, 4))) for _ in range(3000)).encode()
    assert quality.in_bands(prose, compress)[2]
    assert not quality.in_bands(b"again and again " * 400, compress)[2]
    assert not quality.in_bands(os.urandom(9000), compress)[2]
    assert not quality.in_bands(prose[:4096] + b"la " * 9000, compress)[2]
    assert quality.in_bands(b"", compress) == (None, 0.0, True)
    assert quality.band(quality.WHOLE_BANDS, 150)[0] == 0.30


def noise_and_prose():
    import base64
    import random

    import pyarrow.parquet as pq
    import zstandard

    rng = random.Random(4)

    def noise(n):
        letters = base64.b64encode(rng.randbytes(n)).decode()
        return " ".join(letters[i : i + 10] for i in range(0, n, 10))[:n].encode()

    folder = "/root/testdata/sf0.01/"
    good = {r["doc_id"] for r in pq.read_table(folder + "labels.parquet").to_pylist() if r["quality"] == 1}
    texts = [r["text"].encode() for r in pq.read_table(folder + "documents.parquet").to_pylist() if r["doc_id"] in good and r["text"]]
    return noise, texts, zstandard.ZstdCompressor(level=3).compress


def test_short_noise_is_rejected():
    noise, texts, compress = noise_and_prose()
    for least, most in ((112, 200), (200, 300), (300, 400), (400, 600), (600, 1600), (1600, 6400)):
        kept = sum(quality.in_bands(noise(n), compress)[2] for n in range(least, most, 3))
        assert kept == 0, (least, kept)
        clean = [t[:n] for t in texts for n in (least, most - 1) if len(t) >= n]
        assert sum(quality.in_bands(t, compress)[2] for t in clean) >= 0.98 * len(clean), least


def test_long_texts_with_noise_chunks_are_rejected():
    noise, texts, compress = noise_and_prose()
    prose = b" ".join(texts)[: 40 * quality.CHUNK_BYTES]
    for chunks in (8, 9, 20):
        clean = prose[: chunks * quality.CHUNK_BYTES]
        assert quality.in_bands(clean, compress)[2]
        for more in range(-(-chunks // 5), chunks // 2 + 1):
            assert not quality.in_bands(clean + noise(more * quality.CHUNK_BYTES), compress)[2]
            at = 2 * quality.CHUNK_BYTES + 1000
            assert not quality.in_bands(clean[:at] + noise(more * quality.CHUNK_BYTES) + clean[at:], compress)[2]


def test_clean_documents_are_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = quality.quality(docs)
    assert out.where("NOT base_failed AND NOT kept").count() <= 0.01 * docs.count()


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred <> 'und'").collect()
    assert len(got) > 200 and sum(r.lang_pred == r.lang for r in got) >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !", "fr"), (4, "le la les des " * 30, "fr"), (5, "the and of with " * 30, "en"), (6, "the and of", None), (None, "les des", "fr"), (7, "½ ²", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS language", "1 AS score")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    assert {i: got[i].lang_pred for i in (1, 2, 3, 7)} == dict.fromkeys((1, 2, 3, 7), "und")
    assert len(got) == 8 and got[None].held_out is False
    assert language.identify(docs.limit(0)).count() == 0
    unlabelled = docs.drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang")
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}
    kept = language.keep_known(spark.read.parquet(DOCUMENTS))
    assert kept.columns == spark.read.parquet(DOCUMENTS).columns


def brute_chats(rows):
    turns = collections.defaultdict(set)
    for c, n, role, text in rows:
        turns[c].add((n, role or "", text or ""))
    convs = {c: [(r, t) for _, r, t in sorted(x, key=lambda y: (y[0] is not None, y[0] or 0, y[1], y[2]))] for c, x in turns.items()}
    out = set()
    for c, x in convs.items():
        same = [d for d, y in convs.items() if y == x]
        longer = any(len(y) > len(x) and y[: len(x)] == x for y in convs.values())
        ids = [d for d in same if d is not None]
        if not longer and c == (min(ids) if ids else None):
            out.add((c, len(x), len(same), "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in x)))
    return out


@pytest.mark.parametrize("block", [1024, 2])
def test_chats(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    rows = [(1, 0, "user", "hi"), (1, 1, "bot", "yo"), (2, 0, "user", "hi"), (3, 5, "user", "hi"), (3, 7, "bot", "yo"), (3, 9, "user", "bye"), (4, 0, "user", "x"), (5, 0, "user", "x"), (None, 0, "user", "q")]
    rows += [(6, None, None, None), (6, 1, "user", "a"), (6, 1, "user", "a"), (6, 1, "bot", "a"), (7, 0, "user", "y" * 50_000), (8, 0, "bot", "hi"), (9, -3, "user", "hi"), (9, 4, "bot", "yo"), (9, 4, "bot", "zz")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS idx", "2 AS block")
    assert {tuple(r) for r in chat.render(turns).collect()} == brute_chats(rows)
    assert chat.render(turns.limit(0)).count() == 0
    real = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {tuple(r) for r in chat.render(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")).collect()}
    assert got == brute_chats(real)


def test_pipeline_stages_against_brute_force(spark):
    """Null and repeated ids, null and empty texts, repeated rows and columns that clash: each stage on what the one
    before it kept."""
    from test_exact_and_near import brute_components, brute_fingerprint
    from test_substrings import brute

    real = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(DOCUMENTS).limit(60).collect()]
    near = " ".join(f"the word{k} and" for k in range(200))
    odd = [(None, real[0][1], "en"), (None, near + " x", "en"), (7000, near + " y", "en"), (7000, "completely other text with the and of words", "en"), (7001, None, "en"), (7002, "", None), (7003, "123", "en")]
    rows = [(*r, "s", 1, 2, "k", True) for r in [*real, *odd, odd[3], odd[2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key int, fp string, kept boolean").repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    known = cut(stages["language"](spark, docs, ""), "a")
    assert known.columns == docs.columns
    a = [(r.doc_id, r.text) for r in known.collect()]
    assert all(t and language.has_letter(t) for _, t in a) and len(a) >= len(rows) - 6
    exact = cut(stages["exact"](spark, known, ""), "b")
    first = {}
    for i, t in a:
        k = re.sub(r"[\x20\x09-\x0D]+", " ", t)
        first[k] = min(first.get(k, (True, 0)), (i is None, i or 0))
    b = [(r.doc_id, r.text) for r in exact.collect()]
    assert collections.Counter((re.sub(r"[\x20\x09-\x0D]+", " ", t), (i is None, i or 0)) for i, t in b) == collections.Counter(first.items())
    one = cut(stages["near"](spark, exact, ""), "c")
    component = brute_components([brute_fingerprint(t) for _, t in b])
    groups = collections.defaultdict(list)
    for i, t in b:
        groups[component[brute_fingerprint(t)]].append((i is None, i or 0))
    c = [(r.doc_id, r.text) for r in one.collect()]
    assert sorted((i is None, i or 0) for i, _ in c) == sorted(map(min, groups.values()))
    stripped = cut(stages["passages"](spark, one, ""), "d")
    want = collections.Counter({k: n for k, n in brute(c, 200).items()})
    left = collections.defaultdict(list)
    for r in stripped.collect():
        left[r.doc_id].append(len(r.text.encode()))
    assert sum(map(len, left.values())) == len(c)
    assert all(any(0 <= (n - gone) - x <= 6 * spans for x in left[i]) for i, n, gone, spans, _ in want)
    pieces = stages["packing"](spark, stripped, "").collect()
    assert {r.doc_id for r in pieces} == set(left)
    for sf in (docs.limit(0),):
        for name, stage in corpus_pipeline.STAGES:
            sf = cut(stage(spark, sf, ""), name)
        assert sf.count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(DOCUMENTS)
    base, count = docs.columns, [docs.count()]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs
        docs = cut(stage(spark, docs, "/root/testdata/sf0.001"), name)
        if name != "packing":
            assert docs.columns == base
            count.append(docs.count())
    texts = [r.text for r in seen["near"].collect()]
    assert len(texts) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t) for t in texts})
    assert count[1] >= 0.98 * count[0] and count == sorted(count, reverse=True)
    assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in seen["packing"].collect()}
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").columns == docs.columns
