"""Fill-in-the-middle: cuts against regular expressions, exact round trips, edge cases."""

import hashlib
import random
import re

import pytest

from weftline.llm import fill_in_middle as fim

UNITS = {"line": re.compile(r"[^\n]*\n|[^\n]+"), "word": re.compile(r"[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"), "char": re.compile(r"[\s\S]")}
ALPHABET = ["\n", "\n\n", " ", "\t", "a", "é", "漢字", "😀", "word", "\r\n", "<P", "S>", "<"]


def texts():
    random.seed(11)
    return ["", "\n", "\n\n\n", "a", "a\n", "\na", "é\n😀"] + ["".join(random.choices(ALPHABET, k=random.randint(1, 60))) for _ in range(300)]


@pytest.mark.parametrize("unit", list(UNITS))
def test_runs_find_every_cut(unit):
    for text in texts():
        parts = UNITS[unit].findall(text)
        runs = fim.Runs(text.encode(), unit)
        assert runs.units == len(parts)
        at = 0
        for u, part in enumerate(["", *parts]):
            at += len(part.encode())
            assert runs.offset(u) == at


def brute(doc_id, text, rate=100, spm=50):
    text = text or ""
    parts = UNITS["line"].findall(text)
    h = hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return len(parts), "plain", None, None, text
    a, b = sorted((h1 % (len(parts) + 1), h2 % (len(parts) + 1)))
    p, m, s = ("".join(x) for x in (parts[:a], parts[a:b], parts[b:]))
    if h4 % 100 < spm:
        return len(parts), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(parts), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate", [100, 40])
def test_transform_and_restore(spark, rate):
    rows = list(enumerate(texts())) + [(5, None), (5, "a\nb\nc"), (5, "a\nb\nc"), (900, "x <M> y\n"), (901, "l\n" * 400_000), (902, "one line " * 60_000), (None, None)]
    docs = spark.createDataFrame([(d, t, "n", 1) for d, t in rows], "doc_id long, text string, form string, n int")
    made = fim.transform(docs, rate=rate)
    got = sorted((str(r.doc_id), r.n, r.form, str(r.prefix_chars), str(r.middle_chars), r.output) for r in made.collect())
    assert got == sorted((str(d), *(str(x) if 2 <= k < 4 else x for k, x in enumerate(brute(d, t, rate)))) for d, t in rows)
    back = made.select("doc_id", fim.restored().alias("text")).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(d), t or "") for d, t in rows)
    if rate == 40:
        assert 0.2 < sum(g[2] != "plain" for g in got) / len(got) < 0.6


def test_null_ids_and_empty_tables(spark):
    rows = fim.digest(fim.transform(spark.createDataFrame([(None, "a\nb"), (None, "a\nb")], "doc_id long, text string"))).collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0].restored_sha256 == hashlib.sha256(b"a\nb").hexdigest()
    assert fim.digest(fim.transform(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
