"""Suffix dedup: what is dealt and merged grows with the input, not with its square."""

import random

import numpy as np

from weftline.llm import suffix_dedup


def test_texts_are_dealt_together(spark):
    random.seed(8)
    texts = [" ".join(f"w{random.randrange(10**6)}" for _ in range(5000)) for _ in range(100)]  # 4 MB: several slices
    docs = spark.createDataFrame([(i, 0, t, bytearray(np.arange(0, 20_000, 40).astype("<u4").tobytes())) for i, t in enumerate(texts)], "doc_id long, row long, text string, places binary").coalesce(1)
    assert suffix_dedup._anchor_scan(docs, 8).groupBy("bucket").count().filter("count > 1").isEmpty()
    assert suffix_dedup._contexts(docs, 8).groupBy("bucket").count().filter("count > 1").isEmpty()


def test_contexts_that_meet_nothing_are_left_out():
    rng = np.random.default_rng(2)
    ctx = rng.integers(97, 123, (5, suffix_dedup.CONTEXT)).astype(np.uint8)
    ctx[:, 34:50] = ctx[0, 34:50]
    ctx[1, 17:34] = ctx[0, 17:34]  # all of 17 bytes before the anchor
    ctx[3, 50:66] = ctx[2, 50:66]  # one less than 17 bytes behind it
    ctx[4, 50:67] = ctx[1, 50:67]
    assert suffix_dedup.may_meet(ctx, np.zeros(5, np.uint64)).tolist() == [True, True, False, False, True]
    assert suffix_dedup.may_meet(ctx, np.arange(5, dtype=np.uint64)).tolist() == [False] * 5


def test_keys_of_one_array_and_of_many():
    rng = np.random.default_rng(4)
    key = np.repeat(np.arange(40), rng.integers(1, 30, 40))
    ctx = rng.integers(97, 99, (len(key), suffix_dedup.CONTEXT)).astype(np.uint8)
    ctx[:, 20:70] = 97  # long runs in common
    ctx[:, 34] = 130 + key  # what tells keys apart is in every string
    ctx[::7, 60:] = suffix_dedup.GAP
    least = rng.integers(0, 1000, len(key))
    want = suffix_dedup.least_owner(ctx, least)
    for size in (500, 3000, 1 << 20):
        assert (suffix_dedup.merged_owners(ctx, least, size, key) == want).all()
        assert (suffix_dedup.merged_owners(ctx, least, size) == want).all()
