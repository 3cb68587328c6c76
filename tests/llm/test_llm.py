"""Training-data operators: edge cases, and each against a brute-force version or held-out labels."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import jaccard_join, language_id, media, packing, quality, queries, sentence_pieces, substring_dedup, suffix_dedup, token_counts, toxicity
from weftline.llm.components import components

SF = "/root/testdata/sf0.01"
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(6000))
PASSAGE = " ".join(f"shared{i} passage{i * 7}." if i % 6 == 5 else f"shared{i} passage{i * 7}" for i in range(40))
ROWS = [(1, None), (2, ""), (3, "  \n "), (4, "one two"), (5, "One TWO"), (6, LONG), (7, LONG), (8, LONG + " tail"), (9, PASSAGE), (10, " ".join(f"lead{i}" for i in range(80)) + f". {PASSAGE} and after it that."), (9, PASSAGE), (None, PASSAGE), (11, "é漢字 <|endoftext|> İ")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "x", "y", 0) for d, t in ROWS], "doc_id long, text string, lang string, n_words string, score int")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_token_counts(docs):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), chunk_chars=500, overlap=16).collect()
    assert len(rows) == len(ROWS)
    want = {d: len(tok.encode(t or "", add_special_tokens=False).ids) for d, t in ROWS}
    assert all(r.n_tokens == want[r.doc_id] and r.over_limit == (r.n_tokens > 512) for r in rows)


def test_token_counts_resynchronise():
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    random.seed(1)
    parts = ["abc ", "  ", "\n\n \n", "<|endoftext|>", "don't ", "12345", "é漢字", "!!!", " " * 40, "x" * 50, "the "]
    for _ in range(60):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 200)))
        assert token_counts.count_long(tok, text, 300, 40) == len(tok.encode(text, add_special_tokens=False).ids)


def test_packing(docs):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    ids = {d: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in ROWS}
    assert sum(r.length for r in rows) == sum(len(ids[d]) for d, _ in ROWS)
    windows = {}
    for r in rows:
        assert r.ids == ids[r.doc_id][r.start : r.start + r.length].tobytes() and r.doc_tokens == len(ids[r.doc_id])
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 2048
    digests = packing.pack_digests(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sorted((str(r.doc_id), r.start, r.ids_crc32) for r in digests) == sorted((str(r.doc_id), r.start, zlib.crc32(r.ids)) for r in rows)


def test_best_fit_decreasing_is_the_plain_one():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 65, 200)
    where, offset = packing.best_fit_decreasing(lengths, 64)
    rooms = []
    for i in np.argsort(-lengths, kind="stable"):
        fit = [r for r in rooms if r >= lengths[i]]
        room = min(fit) if fit else 64
        if fit:
            rooms.remove(room)
        assert offset[i] == 64 - room
        rooms.append(room - lengths[i])
    assert where.max() + 1 == len(rooms)


def test_sentence_pieces(docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = sentence_pieces.encode(docs, path).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == sp.encode(r.text) and r.decoded == sp.decode(ids)


def test_sentence_pieces_unigram():
    model = sentence_pieces.Model([("<unk>", 0.0, 2), ("▁a", -1.0, 1), ("b", -2.0, 1), ("▁", -3.0, 1), ("a", -3.0, 1), ("ab", -2.5, 1)])
    tok = sentence_pieces.build(model)
    assert tok.encode("ab  a").tokens == ["▁a", "b", "▁a"]
    assert tok.decode(tok.encode("ab a").ids) == "ab a"


def test_media(spark, docs, tmp_path):
    made = media.store(docs, str(tmp_path / "m"), archive_bytes=2000)
    rows = media.with_features(media.read_media(spark, made, rangeBytes=700)).collect()
    assert sorted((str(r.doc_id), r.payload) for r in rows) == sorted((str(d), media.pad((t or "").encode())) for d, t in ROWS)
    assert all(media.from_png(r.media) == r.payload for r in rows)
    assert media.read_media(spark, media.store(docs.limit(0), str(tmp_path / "none"))).count() == 0


def test_media_retries_one_member(spark, docs, tmp_path, monkeypatch):
    reader = media.ZipMediaReader({"path": media.store(docs, str(tmp_path / "m"))})
    real, calls = zlib.crc32, []
    monkeypatch.setattr(media.zlib, "crc32", lambda x, *a: (calls.append(1), 0 if len(calls) == 1 else real(x, *a))[1])
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == len(ROWS)


def brute_spans(rows):
    first, out = {}, {}
    for d, t in sorted({(d, t) for d, t in rows if d is not None}, key=lambda r: r[0]):
        data = (t or "").encode()
        hit, new = bytearray(len(data)), []
        for i in range(len(data) - 49):
            s = data[i : i + 50]
            if s in first:
                hit[i : i + 50] = b"\1" * 50
            else:
                new.append(s)
        first.update(dict.fromkeys(new, 1))
        out[d] = bytes(x for x, h in zip(data, hit, strict=True) if not h)
    return out


def test_suffix_dedup(spark, docs):
    want = brute_spans(ROWS)
    rows = suffix_dedup.dedup(docs).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r.kept == (PASSAGE.encode() if r.doc_id is None else want[r.doc_id])
        assert r.n_removed == r.n_bytes - len(r.kept)
    assert suffix_dedup.dedup(docs.limit(0)).count() == 0


def test_suffix_dedup_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 300")
    got = {r.doc_id: hashlib.sha256(r.kept).hexdigest() for r in suffix_dedup.dedup(rows).collect()}
    assert got == {d: hashlib.sha256(k).hexdigest() for d, k in brute_spans([(r.doc_id, r.text) for r in rows.collect()]).items()}


def test_suffix_array():
    rng = np.random.default_rng(1)
    for text in (rng.integers(97, 99, 400).astype(np.uint8), np.tile(rng.integers(97, 100, 7), 60).astype(np.uint8)):
        sa = suffix_dedup.suffix_array(text)
        cut = [text[i : i + 50].tobytes() for i in sa]
        assert cut == sorted(cut)
        lcp = suffix_dedup.common_prefixes(text, sa)
        for i in range(1, len(sa)):
            n = 0
            while n < min(len(cut[i]), len(cut[i - 1])) and cut[i][n] == cut[i - 1][n]:
                n += 1
            assert lcp[i] == n
    ctx = rng.integers(97, 99, (300, 84)).astype(np.uint8)
    ctx[5], ctx[200, :60], ctx[30, 70:] = ctx[100], ctx[7, :60], 255
    assert (suffix_dedup.least_owner(ctx, np.arange(300)) == suffix_dedup.merged_owners(ctx, np.arange(300), 2000)).all()


def brute_components(rows):
    sets = {d: s for (d, _), s in zip(rows, jaccard_join.shingle_sets(pa.array([t for _, t in rows], pa.string())), strict=True) if d is not None}
    label = {d: d for d in sets}
    again = True
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a]) and len(sets[b]) and 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))]
    while again:
        again = False
        for a, b in pairs:
            low = min(label[a], label[b])
            again |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {d: (len(sets[d]), label[d]) for d in sets}


def test_jaccard_join(spark, docs):
    rows = jaccard_join.join(docs).collect()
    want = brute_components(ROWS)
    assert len(rows) == len(ROWS)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in rows if r.doc_id is not None)
    assert jaccard_join.join(docs.limit(0)).count() == 0


def test_jaccard_join_near_threshold(spark):
    random.seed(5)
    base = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(base))]
    for d in range(1, 120):
        words = list(base) if d % 3 else [f"u{d}_{i}" for i in range(60)]
        for _ in range(random.randint(0, 4)):
            words[random.randrange(60)] = f"e{random.randrange(5)}"
        rows.append((d, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), block=16).collect()}
    assert got == brute_components(rows)


def test_components(spark):
    random.seed(3)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(None, 3), (5, 5)]
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {tuple(r) for r in components(df).collect()} == {tuple(r) for r in components(df, small=0).collect()}


def test_substring_dedup(spark, docs):
    rows = substring_dedup.dedup(docs).collect()
    got = by_id(spark.createDataFrame([(r.doc_id, r.text, r.n_removed_words) for r in rows if r.doc_id is not None], "doc_id long, text string, n int"))
    assert len(rows) == len(ROWS)
    assert got[9].text == PASSAGE and got[6].text == LONG and got[1].text is None
    assert got[10].n >= 60 and got[10].text.startswith("lead0 lead1 ")
    assert got[7].text == ""
    assert substring_dedup.dedup(docs.limit(0)).count() == 0


def test_quality_counts():
    text = "a b c d e f\nx # $\na b c d e f\n\nx # $"
    counts, _ = quality.statistics(pa.array([None, "", text, "a b c d e f"]).slice(1))
    assert counts["n_words"].tolist() == [0, 18, 6]
    assert counts["n_symbols"].tolist() == [0, 4, 0]
    assert counts["n_dup_lines"].tolist() == [0, 2, 0]
    assert counts["n_repeat_words"].tolist() == [0, 18, 0]
    assert counts["word_chars"].tolist() == [0, 18, 6]


def test_quality_monotone():
    rng = np.random.default_rng(0)
    x = rng.random((500, len(quality.FEATURES)))
    y = (x[:, 2] + 0.5 * rng.random(500) < 0.7).astype(float)
    forest = quality.train(x, y, monotone=quality.MONOTONE)
    assert ((forest.score(x) >= 0.5) == y).mean() > 0.85
    for k, sign in enumerate(quality.MONOTONE):
        if sign:
            grid = np.repeat(x[:50], 20, axis=0)
            grid[:, k] = np.tile(np.linspace(0, 1, 20), 50)
            assert (np.diff(forest.score(grid).reshape(50, 20), axis=1) <= 1e-12).all()


def test_quality_rules(spark, docs):
    rows = quality.judge(docs, None).collect()
    assert len(rows) == len(ROWS) and not any(r.kept for r in rows if r.n_words < 10)


def test_language_id(spark, docs):
    full = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identify(full, language_id.fit(full)).join(full.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    model = language_id.fit(docs)
    rows = by_id(language_id.identify(docs, model))
    assert rows[1].lang_pred == rows[2].lang_pred == rows[3].lang_pred == "und"


def test_gru_gradients():
    from weftline.llm import gru

    rng = np.random.default_rng(2)
    table, u = rng.standard_normal((9, 5)).astype(np.float32) * 0.5, gru.init(rng, 3)
    idx = rng.integers(0, 5, (4, 2))
    want = rng.standard_normal((4, 3, 2)).astype(np.float32)
    _, kept = gru.forward(table, u, idx, None, False, keep=True)
    du, dx = gru.backward(u, kept, want, None)
    for m, g in ((u, du), (table, gru.scatter(dx, idx, 5))):
        at = (1, 2)
        m[at] += 1e-2
        up = (gru.forward(table, u, idx, None, False) * want).sum()
        m[at] -= 2e-2
        down = (gru.forward(table, u, idx, None, False) * want).sum()
        m[at] += 1e-2
        assert g[at] == pytest.approx((up - down) / 2e-2, abs=2e-2)


def test_toxicity():
    random.seed(0)
    words = [f"w{i}" for i in range(300)]
    make = lambda bad: " ".join(random.choices(words, k=120) + (["vile"] if bad else []) + random.choices(words, k=60))
    y = np.arange(240) % 2
    net = toxicity.train([make(k) for k in y], y, rounds=2, steps=60)
    assert ((net.score(pa.array([make(k) for k in y])) >= 0.5) == y).mean() > 0.9
    assert len(net.score(pa.array([None, "", "a"], pa.string()))) == 3
    assert toxicity.train(["a"], np.array([1])).score(pa.array(["a"])).tolist() == [0.0]


def test_pipeline(spark):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


def test_jaccard_join_combined_keys():
    """A key of several documents goes on once and counts for each of them."""
    keys, owner, count = jaccard_join.combined(np.array([7, 5, 7, 9, 5, 7], np.uint64), np.array([0, 0, 1, 1, 2, 2]), 3)
    assert keys.tolist() == [5, 7, 9] and owner.tolist() == [jaccard_join.MANY, jaccard_join.MANY, 1] and count.tolist() == [2, 1, 2]
    rows = list(jaccard_join.bucket_rows(keys, owner, np.array([10, 11, 12]), 1))
    assert np.frombuffer(rows[0][3], "<i8").tolist() == [11]
    ids, c = jaccard_join.shared_keys([rows[0][1:], next(jaccard_join.bucket_rows(np.array([7, 9], np.uint64), np.array([0, 0]), np.array([20]), 1))[1:]])
    assert dict(zip(ids.tolist(), c.tolist(), strict=True)) == {11: 1, 20: 2}


def test_substring_dedup_inside_sentences(spark):
    def words(n, tag):
        return [f"{tag}{i}" for i in range(n)]

    def around(passage, tag):
        return " ".join(words(25, tag) + passage + words(25, tag + "end"))

    plain = words(60, "plain")  # no stops, in mid-sentence
    stops = [w + "." if i % 17 == 9 else w for i, w in enumerate(words(60, "stops"))]
    changed = words(150, "changed")
    other = ["new" if i in (40, 90) else w for i, w in enumerate(changed)]
    twice = ["other" if i % 8 == 7 else w for i, w in enumerate(words(60, "twice"))]
    texts = [around(p, f"d{k}x") for k, p in enumerate((plain, plain, stops, stops, changed, other, words(60, "twice"), twice))]
    got = by_id(substring_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [got[k].n_removed_words for k in range(8)] == [0, 60, 0, 60, 0, 150, 0, 0]
    assert all(got[k].text == around([], f"d{k}x") for k in (1, 3, 5))


def test_substring_dedup_fills_similar_gaps():
    rng = np.random.default_rng(5)
    for _ in range(300):
        edge = np.cumsum(rng.integers(1, 40, 14))
        start, stop = edge[::2], edge[1::2]
        want = np.zeros(7, bool)
        for i in range(7):
            for j in range(i + 1, 7):
                gaps = start[i + 1 : j + 1] - stop[i:j]
                n, c = stop[j] - start[i] - 4, int((gaps + 4).sum())
                if gaps.max() < 10 and 100 * (n - c) >= 75 * (n + c):
                    want[i:j] = True
        assert substring_dedup.filled(start, stop, 75).tolist() == want.tolist()


def test_substring_dedup_shared_template(spark):
    # 300 pairs of similar lines, all with one template: its band keys hold many contents
    template = [f"template{i}" for i in range(30)]
    rows = []
    for k in range(300):
        own = [f"own{k}x{i}" for i in range(10)]
        rows += [(k, " ".join(template + own)), (300 + k, " ".join(template + own[:-3] + [f"end{k}x{i}" for i in range(3)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.lines for r in substring_dedup.repeats(docs).collect()}
    assert [k for k in range(600) if found.get(k)] == list(range(300, 600))


def test_substring_dedup_short_units(spark):
    sentences = " ".join(f"{w}." if i % 12 in (5, 8, 11) else w for i, w in enumerate(f"verse{i}" for i in range(60)))
    lines = "\n".join(f"item{i} of list{i}" for i in range(20))
    rows = [(0, sentences), (1, " ".join(f"before{i}" for i in range(30)) + ". " + sentences + " " + " ".join(f"after{i}" for i in range(30))), (2, lines), (3, "head\n" + lines + "\nfoot")]
    got = by_id(substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[k].n_removed_words for k in range(4)] == [0, 60, 0, 60]


def brute_run_words(rows, size):
    """{(doc_id, text): places of words in runs of size words that a smaller doc_id has too}"""
    first, out = {}, {}
    split = [(d, t, (t or "").split()) for d, t in rows]
    for d, _, w in split:
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            first[key] = min(d, first.get(key, d))
    for d, t, w in split:
        hit = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                hit.update(range(i, i + size))
        out[d, t] = hit
    return out


def test_substring_dedup_against_brute_force(spark):
    """Words in runs of 30 that a smaller doc_id has go; nearly all that goes is in a shared run of 10."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.lower("text").alias("text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, near = brute_run_words(rows, 30), brute_run_words(rows, 10)
    total = caught = gone = stray = 0
    for r, old in zip(sorted(substring_dedup.dedup(docs).collect(), key=lambda r: r.doc_id), sorted(rows), strict=True):
        at = [m.start() for m in substring_dedup._WORD.finditer(old[1])]
        lost = {i for s in r.spans for i in range(*np.searchsorted(at, [s.start, s.stop]))}
        assert len(lost) == r.n_removed_words and r.n_words == len(at)
        total, caught = total + len(want[old]), caught + len(want[old] & lost)
        gone, stray = gone + len(lost), stray + len(lost - near[old])
    assert caught > 0.99 * total and stray < 0.05 * gone


def test_substring_dedup_repeated_ids(spark):
    """Rows of one doc_id are told apart by their text; a row that repeats wholly keeps its text."""
    a, b = (" ".join(f"{t}{i}" for i in range(60)) for t in "ab")
    rows = [(3, a), (7, a), (7, b), (7, b), (9, b), (9, a + " " + b)]
    got = [(r.doc_id, r.text, r.n_removed_words) for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted([(3, a, 0), (7, "", 60), (7, b, 0), (7, b, 0), (9, "", 60), (9, "", 120)])


def test_substring_dedup_pieces_meet():
    """Two texts that share a run of 2 * REACH + 4 words share a piece of it, wherever it stands."""
    rng = random.Random(4)
    size = 2 * substring_dedup.REACH + 4
    for k in range(200):
        run = [f"r{k}x{i}" for i in range(size)]
        texts = [" ".join([f"{t}{i}" for i in range(rng.randrange(30))] + run + [f"{t}e{i}" for i in range(rng.randrange(30))]) for t in "ab"]
        key, text, _, _ = substring_dedup.Paragraphs(pa.array(texts)).pieces()
        assert set(key[text == 0].tolist()) & set(key[text == 1].tolist())


def test_hot_join(spark):
    from weftline.llm.common import cut, hot_join

    many = spark.range(500).selectExpr("if(id < 300, 0, id) AS k", "id")
    one = cut(spark.range(400).selectExpr("id AS k", "id * 2 AS v"))
    counts = cut(many.groupBy("k").agg(F.count(F.lit(1)).alias("n")))
    got = hot_join(many, one, ["k"], counts, least=10, most_keys=5)
    assert sorted(map(tuple, got.select("id", "v").collect())) == sorted(map(tuple, many.join(one, "k").select("id", "v").collect()))


def test_packing_encoder_on_every_character():
    """The word encoder gives the library's ids for every character of its range, wherever it stands."""
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, enc = Tokenizer.from_file(path), packing.WordEncoder(path)
    texts = [t for c in map(chr, [9, 10, 13, *range(0x20, 0x7F), *range(0xA0, 0x260)]) for t in (c, f"a{c}", f"{c}a", f"a{c}b", f"1{c}", f"{c}1", f"A{c}!", f"é{c}{c} {c}", f"'{c}s", f"!{c}?")]
    got = enc.encode(texts)
    assert [x.tolist() for x in got] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_language_id_letters(spark):
    rows = [(1, "½ ² Ⅷ 12 !"), (2, "ª"), (3, None), (4, "́")]
    model = language_id.train([(b"abc abc abc", "x"), (b"xyz xyz xyz", "y")], steps=5)
    got = by_id(language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), model))
    assert [got[k].lang_pred == "und" for k in (1, 2, 3, 4)] == [True, False, True, True]
    long = bytes(range(65, 91)) * 500
    assert len(language_id.drawn(long, 24, 1)) == 24 * language_id.WINDOW and language_id.drawn(b"ab", 24, 1) == b"ab"


def test_bounded_sample(spark):
    from weftline.llm.common import bounded_sample

    docs = spark.createDataFrame([(k, "x" * (100 if k % 2 else 5000)) for k in range(40)] + [(3, "b"), (None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 8)) for k in range(40)] + [(9, 1), (None, 1), (50, 1), (10, 7)], "doc_id long, toxic int")
    rows = bounded_sample(labels, docs, "toxic", 6).collect()
    assert len(rows) == 12 and len({r.doc_id for r in rows}) == 12 and not {9, 10, 50} & {r.doc_id for r in rows}
    # by hash alone: long and short texts alike
    order = [r[0] for r in docs.filter("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").collect() if r[0] not in (9, 10)]
    for toxic in (0, 1):
        assert {r.doc_id for r in rows if r.toxic == toxic} == set([k for k in order if (k < 8) == bool(toxic)][:6])
    assert {len(r.text) for r in rows} >= {100, 5000}
    assert all(r.text == "b" for r in rows if r.doc_id == 3)


def test_sentence_pieces_strings_of_other_pieces(tmp_path):
    model = sentence_pieces.Model([("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("▁", -3.0, 1), ("a", -3.0, 1), ("<", -3.0, 1), ("s", -3.0, 1), (">", -3.0, 1)])
    assert sentence_pieces.build(model).encode("a<s>").tokens == ["▁", "a", "<", "s", ">"]
    with pytest.raises(ValueError):
        sentence_pieces.build(sentence_pieces.Model([("<unk>", 0.0, 2), ("<sep>", 0.0, 4)], kind=2))


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    net, forest, model = toxicity.fit(none, labels), quality.fit(none, labels), language_id.fit(none)
    path = public_tokenizers.path("byte_bpe_50k.json")
    made = [toxicity.score(none, net), quality.judge(none, forest), language_id.identify(none, model), token_counts.count_tokens(none, path), packing.pack_digests(none, public_tokenizers.path("word_bpe_49k.json")), sentence_pieces.encode(none, public_tokenizers.path("piece_bpe_32k.model"))]
    assert [d.count() for d in made] == [0] * 6
    assert len(toxicity.score(docs, net).collect()) == len(ROWS) and {r.lang_pred for r in language_id.identify(docs, model).collect()} == {"und"}


def test_pipeline_stages_on_odd_rows(spark, monkeypatch):
    """Each filtering stage keeps whole rows, by their own text; nulls, repeats and empty tables are defined."""
    import corpus_pipeline

    model = language_id.train([(b"abcd " * 40, "x"), (b"wxyz " * 40, "y")], steps=60)
    monkeypatch.setattr(corpus_pipeline.language_id, "fit", lambda *a, **k: model)
    rows = [(1, "abcd abcd", "x", "s", 9), (None, "abcd", None, None, None), (2, "", "x", "s", 0), (3, None, "x", "s", 0), (1, "wxyz wxyz", "y", "s", 9), (4, "123", None, "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.language(spark, docs, SF)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if r.text in ("abcd abcd", "abcd", "wxyz wxyz"))
    long, lead = (" ".join(f"{t}{i}" for i in range(n)) for t, n in (("w", 50), ("lead", 20)))
    rows = [(5, long, "x", "s", 1), (6, long + " end", "x", "s", 1), (7, "other text here", "x", "s", 1), (7, "other text here", "x", "s", 1), (None, long, "x", "s", 1), (8, None, "x", "s", 1)]
    docs = spark.createDataFrame(rows, docs.schema)
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near_copies(spark, docs, SF).collect()) == ["5", "7", "8", "None"]
    docs = spark.createDataFrame([(5, long, "x", "s", 1), (6, long, "x", "s", 1), (7, lead + " " + long, "x", "s", 1), (None, long, "x", "s", 1)], docs.schema)
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.repeated_passages(spark, docs, SF).collect()}
    assert got == {5: (long, 1), 7: (lead, len(lead)), None: (long, 1)}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    import oracle

    assert oracle.difference(queries.queries()[name](spark, SF), oracle.connect(SF), queries.oracle_sql()[name]) == ""


COUNTS_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM places WHERE i <= len(w) - 4),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) t(k) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM w),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(d.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
len(w) < 10 OR 100 * coalesce(c.n, 0) > 20 * len(w) AS base_failed
FROM w LEFT JOIN covered c USING (doc_id) LEFT JOIN dup d USING (doc_id)
"""


def test_quality_counts_against_sql(spark):
    import oracle

    got = quality.judge(spark.read.parquet(f"{SF}/documents.parquet"), None).drop("kept", "score")
    assert oracle.difference(got, oracle.connect(SF), COUNTS_SQL) == ""


def test_quality_rules_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    forest = quality.fit(docs, labels.filter("doc_id % 3 <> 0"))
    rows = quality.judge(docs, forest).join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    assert np.mean([r.kept == bool(r.quality) for r in rows]) > 0.8 and not any(r.kept for r in rows if r.base_failed)


def test_toxicity_sample_in_parts():
    """Words and windows of a training sample read in parts are those of the sample read at once."""
    rng = np.random.default_rng(1)
    texts = ["" if i % 17 == 0 else " ".join(f"wörd{k}" for k in rng.integers(0, 900, rng.integers(1, 200))) for i in range(300)]
    codes, row, lex = toxicity.prepare(pa.array(texts, pa.large_string()))
    for max_bytes in (1, 5_000, 1 << 20):
        c, r, other = toxicity.prepare_in_parts(texts, max_bytes)
        assert np.array_equal(c, codes) and np.array_equal(r, row) and np.array_equal(other.gram, lex.gram)
    words = pa.array(["", "a", "é x", "...", "the"] + [f"w{k}" for k in range(500)], pa.large_string())
    whole, parts = toxicity.Lexicon(words), toxicity.Lexicon(words, 7)
    assert all(np.array_equal(getattr(whole, k), getattr(parts, k)) for k in ("bucket", "gram", "owner", "ends"))
    windows, _ = toxicity.cut_windows(codes, row, len(texts), lex.n)
    net = toxicity.Network.fresh(3)
    np.testing.assert_allclose(net.score_windows(*toxicity.words_in(lex, windows[:40])), net.score_windows(lex, windows)[:40], rtol=1e-4, atol=1e-5)
