"""Substring dedup: every place of a repeated line goes, equal or near."""

import random

import pytest

from weftline.llm import substring_dedup as sd


def line(seed, n=20):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 10**6)}" for _ in range(n))


def changed(text, *places):
    words = text.split()
    for i in places:
        words[i] = "other" + words[i]
    return " ".join(words)


def removed(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {(r.doc_id, r.text): r.n_removed_words for r in sd.dedup(docs).collect()}, {r.doc_id: r.n_removed_words for r in sd.dedup(docs).collect()}


L1, L2, L3 = line(1), line(2), line(3)


def test_equal_lines_of_two_documents(spark):
    _, got = removed(spark, [(1, L1), (2, L2), (3, f"{L1}\n{L2}"), (4, f"{L2}\n{L1}\n{L1}"), (5, L3), (6, f"{L3}\n{line(9)}")])
    assert got == {1: 0, 2: 0, 3: 40, 4: 60, 5: 0, 6: 0}


def test_near_lines_and_their_copies(spark):
    b, e = line(4, 40), line(5, 40)
    near_b, near_e = changed(b, 39), changed(e, 0)
    _, got = removed(spark, [(1, b), (2, e), (3, f"{near_b}\n{near_e}"), (6, f"{near_e}\n{near_b}"), (7, line(6, 40))])
    assert got == {1: 0, 2: 0, 3: 80, 6: 80, 7: 0}


def test_short_near_lines_by_bands_alone(spark):
    """Lines of 25 words whose last word differs: no common run of 30, only the bands can tell."""
    base = [line(20 + i, 25) for i in range(4)]
    near = [changed(x, 24) for x in base]
    _, got = removed(spark, [(i, x) for i, x in enumerate(base)] + [(10, "\n".join(near)), (11, "\n".join(reversed(near)))])
    assert [got[i] for i in range(4)] == [0] * 4 and got[10] == 100 and got[11] == 100


def test_a_long_text(spark):
    """A text of some hundred kB that repeats lines of others among its own."""
    rng = random.Random(7)
    own = [line(1000 + i, 12) for i in range(2500)]
    mixed = []
    for i, x in enumerate(own):
        mixed += [x] if rng.random() < 0.9 else [x, L1, L2]
    text = "\n".join(mixed)
    times = sum(x == L1 for x in mixed)
    _, got = removed(spark, [(1, L1), (2, L2), (9, text), (8, line(77))])
    assert len(text) > 200_000 and got[9] == 40 * times and got[8] == 0


@pytest.mark.parametrize("rows", [[(3, f"{L1}\n{L2}"), (3, f"{L2}\n{L1}"), (1, L1), (1, L2)], [(3, f"{L1}\n{L2}"), (3, f"{L1}\n{L2}"), (2, f"{L1}\n{L2}")]])
def test_repeated_ids(spark, rows):
    got, _ = removed(spark, rows)
    assert all(n == (40 if d == 3 else 0) for (d, _), n in got.items())
