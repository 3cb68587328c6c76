"""Packing token ids into fixed windows by best-fit decreasing.

Every document is encoded, ended with ``end_id`` and cut into full windows; the rest (shorter than a
window) and the full windows are dealt to shards by a hash of (doc_id, start, length). Within a
shard a segment tree over remaining capacities finds the tightest open window for each piece,
longest first; rows without doc_id are dealt by their place in the input. Shards hold about ``pieces_per_shard`` pieces whatever the input, so no task sees the
whole corpus; a shard of some thousand pieces leaves little padding.

Nulls count as empty texts: one piece with the end id. Ties in length go by (doc_id, start).
Repeated rows are packed once each. Extra columns are not carried.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import slices, text_or_empty

WINDOW = 2048
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


class CapacityTree:
    """Counts of open windows by remaining capacity; finds the least capacity that still fits."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.size
        while i:
            self.tree[i] += n
            i >>= 1

    def tightest(self, need: int) -> int:
        """Least capacity >= need with an open window, or -1."""
        i = need + self.size
        if self.tree[i]:
            return need
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece; pieces are taken as ordered, longest first."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    tree, waiting, opened = CapacityTree(window), [[] for _ in range(window + 1)], 0
    for i in order:
        n = int(lengths[i])
        room = tree.tightest(n)
        if room < 0:
            room, w = window, opened
            opened += 1
        else:
            w = waiting[room].pop()
            tree.add(room, -1)
        where[i], offset[i] = w, window - room
        if room > n:
            waiting[room - n].append(w)
            tree.add(room - n, 1)
    return where, offset


def _letters() -> tuple[str, str]:
    """Latin letters and digits below U+0250 as the two classes of the pattern below."""
    cats = {c: unicodedata.category(chr(c))[0] for c in range(0x250)}
    return tuple("".join(re.escape(chr(c)) for c in cats if cats[c] == k) for k in "LN")


class _Numbers(dict):
    """Numbers words as they are first looked up, and lists the new ones."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class WordEncoder:
    """Ids of a tokenizer that works word by word; each distinct word is encoded by the library once.

    Only for a tokenizer that composes Unicode, lower-cases, drops white space and splits by the
    word pattern below. Texts with characters outside U+0020..U+024F (tab and line ends aside), or
    whose lower case is outside, where library and Python might disagree, and texts with a special
    string go to the library whole.
    """

    def __init__(self, path: str, cache: int = 400_000):
        from tokenizers import Tokenizer

        letter, number = _letters()
        leaving = "".join(chr(c) for c in range(0x80, 0x250) if any(ord(x) > 0x24F for x in chr(c).lower()))
        self.tok, self.limit = Tokenizer.from_file(path), cache
        self.odd = re.compile(f"[^\\t\\n\\r\\x20-\\x7e\\xa0-\\u024f]|[{leaving}]" + "".join("|" + re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()))
        self.word = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^\\s{letter}{number}]+")
        self.ends_word = np.zeros(self.tok.get_vocab_size() + 1, bool)
        for piece, i in self.tok.get_vocab().items():
            self.ends_word[i] = piece.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        self.index = _Numbers()
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, new: list[str]) -> None:
        ids = np.asarray(self.tok.encode(" ".join(new), add_special_tokens=False).ids, np.int64)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(new) or ends[-1] != len(ids):  # a word without an end mark: one by one
            got = [e.ids for e in self.tok.encode_batch_fast(new, add_special_tokens=False)]
            ids = np.fromiter((i for g in got for i in g), np.int64)
            ends = np.cumsum(np.fromiter(map(len, got), np.int64, len(got)))
        base = len(self.flat)
        length = np.diff(ends, prepend=0)
        self.start = np.concatenate([self.start, base + ends - length])
        self.length = np.concatenate([self.length, length])
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        if len(self.index) > self.limit:
            self.clear()
        get, plain = self.index.__getitem__, []
        for i, t in enumerate(texts):
            if self.odd.search(t):
                out[i] = np.asarray(self.tok.encode(t, add_special_tokens=False).ids, np.uint32)
            else:
                words = self.word.findall(t.lower())
                plain.append((i, np.fromiter(map(get, words), np.int64, len(words))))
        if self.index.new:
            self._learn(self.index.new)
            self.index.new.clear()
        for i, at in plain:
            n = self.length[at]
            ends = np.cumsum(n)
            out[i] = self.flat[np.repeat(self.start[at] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a worker process; it holds the words it has met."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def encode_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """Each document's ids (with end_id) cut into pieces of at most a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = encoder(tokenizer_path)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                who, start, length, total, ids = [], [], [], [], []
                for d, x in zip(part.column("doc_id").to_pylist(), enc.encode(part.column("text").to_pylist()), strict=True):
                    x = np.append(x, np.uint32(end_id)).astype("<u4")
                    for a in range(0, len(x), window):
                        who.append(d)
                        start.append(a)
                        length.append(min(window, len(x) - a))
                        total.append(len(x))
                        ids.append(x[a : a + window].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "length", "doc_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, PIECES)


def pack(pieces: DataFrame, shards: int, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length, doc_tokens, and whatever they carry)."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("doc_tokens", "ascending")])
        where, offset = best_fit_decreasing(t["length"].to_numpy(), window)
        shard = t["shard"][0].as_py()
        out = t.drop_columns(["shard"]).append_column("sequence_id", pa.array(shard * (1 << 32) + where, pa.int64()))
        return out.append_column("offset", pa.array(offset, pa.int64()))

    # rows without doc_id are dealt by their place in the input: equal ones may be many
    key = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.col("doc_id"))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64(key, "start", "doc_tokens"), F.lit(shards)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy("shard").applyInArrow(run, f"{fields}, sequence_id long, offset long")


def shards_of(docs: DataFrame, window: int = WINDOW, pieces_per_shard: int = 4096) -> int:
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return max(1, round((n + size / (2 * window)) / pieces_per_shard))  # two bytes a token or more


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids (little-endian unsigned 32 bit), sequence_id, offset of each piece."""
    return pack(encode_pieces(docs, tokenizer_path, end_id, window), shards_of(docs, window), window)


def pack_digests(docs: DataFrame, tokenizer_path: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """As pack_documents with ids_crc32 in place of ids: only lengths and digests travel to the shards."""
    pieces = encode_pieces(docs, tokenizer_path, end_id, window)
    pieces = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(pieces, shards_of(docs, window), window)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from weftline.llm.common import table

    return pack_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
