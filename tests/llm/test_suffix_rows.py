"""Suffix dedup where rows with different texts share a doc_id."""

import hashlib
import random

import pytest

from weftline.llm import suffix_dedup

P = " ".join(f"shared{i} passage{i * 7}" for i in range(40))
A = " ".join(f"alpha{i}" for i in range(200))
B = " ".join(f"beta{i * 3}" for i in range(200))


def brute(rows):
    """Kept bytes of each row: each is judged against the rows of smaller doc_ids."""
    seen, out = set(), []
    for d in sorted({d for d, _ in rows if d is not None}):
        texts = [(t or "").encode() for x, t in rows if x == d]
        for data in texts:
            hit = bytearray(len(data))
            for i in range(len(data) - 49):
                if data[i : i + 50] in seen:
                    hit[i : i + 50] = b"\1" * 50
            out.append((d, bytes(x for x, h in zip(data, hit, strict=True) if not h)))
        seen |= {data[i : i + 50] for data in texts for i in range(len(data) - 49)}
    return sorted(out)


def mixed():
    random.seed(3)
    pool = [A[:300], B[100:500], P, "é漢字 " * 30, A[50:260], "tail " * 4]
    return [(random.randint(0, 12), " ".join(random.choices(pool, k=random.randint(0, 5))) + f" own{i}") for i in range(60)]


@pytest.mark.parametrize("rows", [
    [(1, P + " x"), (7, A + P + B), (7, "hi there")],
    [(3, A), (7, A), (7, B)],
    [(3, A + P), (7, A + P + "1"), (7, B + "2" + P), (7, B), (9, B), (9, B), (9, None), (9, "")],
    [(7, A), (7, A + P), (7, P)],
    mixed(),
])
def test_rows_of_one_id(spark, rows):
    docs = spark.createDataFrame([(d, t, "r", 5) for d, t in rows], "doc_id long, text string, row string, place int").repartition(4)
    got = suffix_dedup.dedup(docs).collect()
    assert sorted((r.doc_id, bytes(r.kept)) for r in got) == brute(rows)
    assert all(r.n_removed == r.n_bytes - len(r.kept) and r.n_spans == len(r.spans) for r in got)
    assert sorted(hashlib.sha256(r.kept).hexdigest() for r in got) == sorted(hashlib.sha256(k).hexdigest() for _, k in brute(rows))
