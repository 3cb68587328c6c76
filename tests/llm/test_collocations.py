"""Phrase collocations against a brute-force version, exact arithmetic, edge cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from weftline.llm import collocations as col


def brute(rows, least, top, most=4, share=80):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, cut = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:cut]], counts[p[cut:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def corpus():
    random.seed(5)
    vocabulary = ["the", "The", "of", "a", "a", "a", "é", "É", "漢字", "x y", "b\x85", "\x1c", "don't", "<P>", "|"]
    joints = [" ", " ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "\x0b", " ; ", "!?"]
    rows = []
    for i in range(300):
        text = "".join(random.choice(vocabulary) + random.choice(joints) for _ in range(random.randint(0, 80)))
        rows.append((random.choice(["en", "fr", None, "", "und"]), text))
    rows += [("en", "New York City hall is a a a a a. ")] * 40 + [(None, None), ("fr", ""), ("de", " \t\n. "), ("es", "solo una vez"), ("en", "of the " * 30_000)]
    return rows


@pytest.mark.parametrize("least,top,shard_bytes", [(2, 2000, 8 << 20), (5, 7, 3000), (30, 2000, 500)])
def test_collocations(spark, least, top, shard_bytes):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, lang, 1, "x") for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, k int, phrase string").repartition(5)
    got = sorted(tuple(r) for r in col.collocations(docs, least=least, top=top, shard_bytes=shard_bytes).collect())
    assert got == brute(rows, least, top)


def test_three_word_phrases(spark):
    rows = corpus()
    docs = spark.createDataFrame([(t, lang) for lang, t in rows], "text string, lang string")
    assert sorted(tuple(r) for r in col.collocations(docs, least=4, top=50, most=3, share=50).collect()) == brute(rows, 4, 50, 3, 50)


def test_products_pass_64_bits(spark):
    big = 9_000_000_000_000_000_001
    counts = spark.createDataFrame([("en", "a b", 2, big - 7), ("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "", 0, big)], "lang string, phrase string, k int, a long")
    row = col.scored(counts).first()
    assert row.score == 2000000 * (big - 7) // (2 * big - 1) and (row.l, row.r) == (big, big - 1)


def test_containment_bound_is_inclusive(spark):
    found = spark.createDataFrame([("en", "a b c", 3, 80), ("en", "a b", 2, 100), ("en", "b c", 2, 101), ("fr", "a b", 2, 100)], "lang string, phrase string, k int, a long")
    assert sorted((r.lang, r.phrase) for r in col.uncontained(found).collect()) == [("en", "a b c"), ("en", "b c"), ("fr", "a b")]


def test_levels_of_ranks(spark):
    found = spark.range(5000).selectExpr("'en' as lang", "concat('p ', id) as phrase", "id % 7 as score", "id % 3 as a")
    got = [(r.phrase, r["rank"]) for r in col.top_per_lang(found, 40).orderBy("rank").collect()]
    want = sorted(range(5000), key=lambda i: (-(i % 7), -(i % 3), f"p {i}"))[:40]
    assert got == [(f"p {i}", k + 1) for k, i in enumerate(want)]


def test_empty_tables(spark):
    assert col.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert col.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).count() == 0


def test_packing_of_cells():
    rng = np.random.default_rng(2)
    cells = np.unique(rng.integers(0, 1 << col.CELLS, 1000)).astype(np.int64)
    assert (col._unpack_sorted(col._pack_sorted(cells), len(cells)) == cells).all()
    values = rng.integers(0, 2**32, 77, dtype=np.uint64)
    assert (col.unpack(col.pack(values), 77) == values).all()


def test_automata_are_bounded(monkeypatch):
    random.seed(6)
    data = col.normalise(". ".join(" ".join(f"w{random.randrange(60)}" for _ in range(12)) for _ in range(400)).encode())
    keys = np.unique(np.concatenate([col.keys_of(g, 1) for _, _, g in col.Tokens("en", data).phrases(3)]))
    sizes, make = [], col.automaton

    def watched(patterns):
        patterns = list(patterns)
        sizes.append(len(patterns))
        return make(patterns)

    monkeypatch.setattr(col, "automaton", watched)
    got = Counter()
    for phrases, words, counts in col.count_shard("en", data, keys, 1, 3, limit=300):
        assert all(len(p.split()) == k for p, k in zip(phrases, words, strict=True))
        got.update(dict(zip(phrases, counts, strict=True)))
    want = Counter()
    for piece in data.decode().split("\n"):
        w = piece.split()
        want[""] += len(w)
        want.update(" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    assert got == want
    assert len(sizes) > 20 and max(sizes) <= 300


def test_shards_are_written_in_small_row_groups(spark):
    import pyarrow.parquet as pq

    docs = spark.range(120, numPartitions=1).selectExpr("array_join(transform(sequence(1, 40000), i -> hash(id, i)), ' ') as text", "'en' as lang")
    written = col.shards(docs, 2 << 20)
    groups = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in written.inputFiles()]
    sizes = [m.row_group(i).total_byte_size for m in groups for i in range(m.num_row_groups)]
    assert sum(sizes) > 40 << 20
    assert max(sizes) < 12 << 20  # one group and one page of all a task's shards before
