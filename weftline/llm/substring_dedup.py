"""Substring dedup over paragraphs: MinHash banding, exact verification, components.

Two kinds of paragraphs are looked up. Lines of five words or more get MinHash signatures of their
5-word shingles in 6 bands of 2 rows: at similarity 0.75 a pair collides with probability 0.993.
Pieces are cut by content, wherever a passage stands (in the middle of lines and sentences, too):
a cut is a shingle whose hash is the least of ``REACH`` shingles in a row, a piece the words from one
cut to the next with the shingle there. Two documents that share a run of 2 * REACH + 4 words share a
piece of it. A piece is too short for a word to differ within similarity 0.75, so all its rows make
one band: its whole content.

1. Scan. Each task combines equal lines and equal pieces of some million words before the shuffle, so
   a passage of a third of all documents reaches its bucket once for each such batch, not once for
   each document; the answers (which pieces a smaller doc_id has, and where) return by batch.
2. Lines of different contents that collide are paired at the first place of each content and
   verified by exact Jaccard similarity of their shingle sets; the lines of a key of more than 8
   contents go through the exact Jaccard join together, so that no pair of theirs is left out.
   Components of verified contents are formed. Then every place of a line, not its first one only, is
   held against the least doc_id that has its content or one of its component: a line of a greater
   doc_id is a repeat.
3. Shared pieces in a row form stretches of one document in another. The words beside a stretch are
   compared with those beside it at its first place (the least doc_id), and it grows while they are
   equal: REACH words a side reach any end. Where stretches of one other document leave gaps of less
   than ``WINDOW`` words (changed words), the gaps are repeats too if the run is similar enough.

Of a document are removed: runs of ``min_words`` words or more in repeated lines and stretches. Texts
without such a run stay as they are, byte for byte. Keys and words are compared by 64-bit hashes; a
run of min_words never rests on one of them alone. A line is named by its doc_id, its number and a hash
of its words.

A-Z are lower-cased for comparison. Null, empty and blank texts and rows without doc_id have no
repeats and are not searched. Rows that share a doc_id are told apart by their text and are not
compared with each other; rows equal in both are one document. Ties go to the row with the smaller
hash. Extra columns are kept, but for those named like one that is added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import jaccard_join
from weftline.llm.common import cut, hot_join, marked_rows, mix64, picked, release, slices, sliding, whole, word_codes, words_of
from weftline.llm.components import components
from weftline.llm.jaccard_join import KEY_BYTES, links, pack_keys, unpack_keys

SHINGLE, BANDS, ROWS, PERCENT, MIN_WORDS = 5, 6, 2, 75, 30
REACH, WINDOW = 13, 2 * SHINGLE
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.uint64((1 << 8 * KEY_BYTES) - 1)
_SEEDS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))
_TOP = np.uint64(2**64 - 1)


class Paragraphs:
    """Words of some texts with their lines and pieces; numbers count within each text."""

    def __init__(self, texts: pa.Array):
        import xxhash

        lines = pc.split_pattern(pc.ascii_lower(whole(texts)), "\n")
        text_of_line = pc.list_parent_indices(lines).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, line = words_of(pc.list_flatten(lines))
        codes, distinct = word_codes(flat)
        h = xxhash.xxh3_64_intdigest
        table = np.fromiter(map(h, distinct.cast(pa.large_binary()).to_pylist()), np.uint64, len(distinct))
        self.hash, self.text = table[codes] if len(codes) else np.zeros(0, np.uint64), text_of_line[line]
        n = len(codes)
        self.size = np.bincount(self.text, minlength=len(texts))
        self.first = np.cumsum(self.size) - self.size  # each text's first word
        self.line_start = np.flatnonzero(np.append(True, line[1:] != line[:-1])[:n])
        self.line_text = self.text[self.line_start]
        self.line_no = line[self.line_start] - np.searchsorted(text_of_line, np.arange(len(texts)))[self.line_text]
        self.line_size = np.diff(np.append(self.line_start, n))
        self.line = np.repeat(np.arange(len(self.line_start)), self.line_size)
        self.gram = np.zeros(max(0, n - SHINGLE + 1), np.uint64)  # of the SHINGLE words from each word on
        for k in range(SHINGLE):
            self.gram = mix64(self.gram * _STEP + self.hash[k : len(self.gram) + k])

    def contents(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A hash of each line's words in their order."""
        if not len(start):
            return np.zeros(0, np.uint64)
        place = (np.arange(len(self.hash)) - np.repeat(start, size)).astype(np.uint64)
        return mix64(np.add.reduceat(mix64(self.hash + mix64(place * _STEP)), start) + size.astype(np.uint64))

    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Content key, text, first word there and number of words of each piece."""
        n = len(self.gram)
        inside = self.text[:n] == self.text[SHINGLE - 1 :][:n]
        g = np.where(inside, np.minimum(self.gram, _TOP - np.uint64(1)), _TOP)
        low = sliding(g, REACH, np.minimum) if n >= REACH else np.zeros(0, np.uint64)
        low[self.text[: len(low)] != self.text[REACH + SHINGLE - 2 :][: len(low)]] = 0  # not all in one text
        wide = np.zeros(n + REACH - 1, np.uint64)
        wide[REACH - 1 : REACH - 1 + len(low)] = low
        at = np.flatnonzero((sliding(wide, REACH, np.maximum) == g) & inside) if n else np.zeros(0, np.int64)
        if len(at) < 2:
            return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
        size = np.diff(np.append(at, n))
        place = (np.arange(at[0], n) - np.repeat(at, size)).astype(np.uint64)
        key = mix64(np.add.reduceat(mix64(self.gram[at[0] :] + mix64(place * _STEP)), at - at[0]) + size.astype(np.uint64))
        ok = np.flatnonzero(self.text[at[1:]] == self.text[at[:-1]])
        start, text = at[ok], self.text[at[ok]]
        return key[ok], text, start - self.first[text], size[ok] + SHINGLE - 1

    def names(self) -> np.ndarray:
        """What tells lines of one doc_id and number apart: their content's hash."""
        return self.contents(self.line_start, self.line_size).view(np.int64)

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """Shingle hashes inside lines, and the line of each."""
        n = len(self.gram)
        ok = self.line[:n] == self.line[SHINGLE - 1 :][:n]
        return self.gram[ok], self.line[:n][ok]

    def bands(self) -> tuple[np.ndarray, np.ndarray]:
        """(lines with shingles, BANDS) keys, and which lines they are."""
        key, of = self.shingles()
        if not len(key):
            return np.zeros((0, BANDS), np.uint64), np.zeros(0, np.int64)
        start = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        out = np.zeros((len(start), BANDS), np.uint64)
        for b in range(BANDS):
            for r in range(ROWS):
                out[:, b] = mix64(out[:, b] * _STEP + np.minimum.reduceat(mix64(key ^ _SEEDS[b * ROWS + r]), start))
            out[:, b] += np.uint64(b)
        return out, of[start]


def _rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, row (tells texts of one doc_id apart) and text of the rows that are searched."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    return ids.select("doc_id", F.xxhash64("text").alias("row"), "text")


_BLOBS = "kind int, bucket long, flush long, keys binary, place binary, unit binary, content binary, ids binary, rows binary"
_LINES, _PIECES, _OWN, _SEEN = 0, 1, 2, 3


def _least(kind_max: int) -> str:
    """The shortest unsigned type for numbers up to kind_max."""
    return "<u2" if kind_max < 1 << 16 else "<u4"


def _numbers(data: bytes, n: int) -> np.ndarray:
    """n unsigned numbers of 2 or 4 bytes."""
    return np.frombuffer(data, "<u4" if len(data) == 4 * n else "<u2").astype(np.int64)


def _pack_ids(ids: np.ndarray) -> bytes:
    """The least of some ids and what the others have more, in 4 bytes each if that is enough."""
    more = ids - ids.min()
    return np.array([ids.min()], "<i8").tobytes() + more.astype("<u4" if 0 <= more.min() and more.max() < 1 << 32 else "<i8").tobytes()


def _unpack_ids(data: bytes, used: int) -> np.ndarray:
    """Ids of which one has the number used, the greatest."""
    more = np.frombuffer(data, "<u4" if len(data) == 12 + 4 * used else "<i8", offset=8)
    return np.frombuffer(data, "<i8", 1)[0] + more.astype(np.int64)


class _Flush:
    """Lines and pieces of some documents; each distinct one goes out once, at its first place."""

    def __init__(self, line_buckets: int, piece_buckets: int):
        self.line_buckets, self.piece_buckets = line_buckets, piece_buckets
        self.clear()

    def clear(self) -> None:
        self.held: dict[str, list[np.ndarray]] = {k: [] for k in ("ids", "rows", "content", "bands", "line_doc", "line_no", "key", "doc", "start", "words")}
        self.docs = self.keys = 0

    def add(self, p: Paragraphs, ids: np.ndarray, rows: np.ndarray) -> None:
        bands, at = p.bands()
        key, text, start, words = p.pieces()
        new = {"ids": ids, "rows": rows, "content": p.contents(p.line_start, p.line_size)[at], "bands": bands, "line_doc": p.line_text[at] + self.docs, "line_no": p.line_no[at], "key": key, "doc": text + self.docs, "start": start, "words": words}
        for k, v in new.items():
            self.held[k].append(v)
        self.docs += len(ids)
        self.keys += len(key) + BANDS * len(at)

    def batch(self, flush: int) -> pa.RecordBatch:
        x = {k: np.concatenate(v) for k, v in self.held.items()}
        made = [*self._lines(x, flush), *self._pieces(x, flush), *self._seen(x, flush)]
        self.clear()
        kinds = (pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 6)
        return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)], [c.split()[0] for c in _BLOBS.split(", ")])

    def _lines(self, x, flush):
        """Packed band keys of lines (content: a hash of their words) by bucket."""
        doc = x["line_doc"]
        order = np.lexsort((x["line_no"], x["ids"][doc], x["content"]))
        content = x["content"][order]
        at = order[np.append(True, content[1:] != content[:-1])[: len(order)]]
        keys, line = x["bands"][at].ravel() & _MASK, np.repeat(at, BANDS)
        of = (keys % np.uint64(self.line_buckets)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        cuts = np.flatnonzero(np.diff(of[order], prepend=-1, append=-1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            r = order[a:b]
            who, where = x["line_doc"][line[r]], x["line_no"][line[r]]
            used, local = np.unique(who, return_inverse=True)
            yield _LINES, int(of[r[0]]), flush, pack_keys(keys[r]), local.astype(_least(len(used))).tobytes(), where.astype(_least(int(where.max()))).tobytes(), x["content"][line[r]].astype("<u8").tobytes(), _pack_ids(x["ids"][used]), None

    def _seen(self, x, flush):
        """All lines that have keys: contents (keys), documents (place: their numbers) and numbers (unit)."""
        doc = x["line_doc"]
        if len(doc):
            used, local = np.unique(doc, return_inverse=True)
            yield _SEEN, flush, flush, x["content"].astype("<u8").tobytes(), local.astype("<u4").tobytes(), x["line_no"].astype("<u4").tobytes(), None, x["ids"][used].astype("<i8").tobytes(), None

    def _pieces(self, x, flush):
        """Packed distinct keys of pieces by bucket, at their first place; and, to read the answers by,
        each piece's rank among them (keys), words (unit) and the pieces of each document (place, content:
        their number and the first word)."""
        key, doc, start = x["key"], x["doc"], x["start"]
        bucket = (key % np.uint64(self.piece_buckets)).astype(np.int64)
        order = np.lexsort((start, x["ids"][doc], key, bucket))
        k = key[order]
        new = np.append(True, k[1:] != k[:-1])[: len(k)]
        rank = np.empty(len(k), np.int64)
        rank[order] = np.cumsum(new) - 1
        at = order[new]
        cuts = np.flatnonzero(np.diff(bucket[at], prepend=-1, append=-1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            r = at[a:b]
            used, local = np.unique(doc[r], return_inverse=True)
            yield _PIECES, int(bucket[r[0]]), flush, key[r].astype("<u8").tobytes(), local.astype(_least(len(used))).tobytes(), start[r].astype(_least(int(start[r].max()))).tobytes(), np.array([a], "<u4").tobytes(), _pack_ids(x["ids"][used]), None
        n = np.bincount(doc, minlength=len(x["ids"]))
        first = np.zeros(len(n), np.int64)
        first[n > 0] = start[(np.cumsum(n) - n)[n > 0]]
        some = np.flatnonzero(n)
        yield _OWN, flush, flush, rank.astype("<u4").tobytes(), n[some].astype("<u4").tobytes(), x["words"].astype("u1").tobytes(), first[some].astype("<u4").tobytes(), x["ids"][some].astype("<i8").tobytes(), x["rows"][some].astype("<i8").tobytes()


def _scan(rows: DataFrame, line_buckets: int, piece_buckets: int, keys_per_flush: int = 300_000) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, flush = TaskContext.get().partitionId() << 24, _Flush(line_buckets, piece_buckets)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                ids, of = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "row"))
                flush.add(Paragraphs(part.column("text")), ids, of)
                if flush.keys >= keys_per_flush:
                    yield flush.batch(name)
                    name += 1
        if flush.docs:
            yield flush.batch(name)

    return rows.mapInArrow(run, _BLOBS)


_PAIRS = "many boolean, doc_id long, unit int, content long, other_doc long, other_unit int, other_content long"


def _owners(t: pa.Table, n: list[int]) -> np.ndarray:
    """doc_id of each key of blobs with n keys."""
    places = [_numbers(place, m) for place, m in zip(t["place"].to_pylist(), n, strict=True)]
    return np.concatenate([_unpack_ids(ids, int(p.max()))[p] for ids, p in zip(t["ids"].to_pylist(), places, strict=True)])


def _line_pairs(scan: DataFrame, few: int = 8) -> DataFrame:
    """Pairs of lines of different content with a band key in common, each at its first place; such
    lines once each (many), without a partner, of keys of more than few contents."""

    def run(t: pa.Table) -> pa.Table:
        release()
        keys = np.concatenate([unpack_keys(x) for x in t["keys"].to_pylist()])
        n = [len(x) // KEY_BYTES for x in t["keys"].to_pylist()]
        doc = _owners(t, n)
        unit = np.concatenate([_numbers(x, m) for x, m in zip(t["unit"].to_pylist(), n, strict=True)])
        content = np.concatenate([np.frombuffer(x, "<i8") for x in t["content"].to_pylist()])
        order = np.lexsort((unit, doc, content, keys))
        k, c = keys[order], content[order]
        lead = order[np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1]))]  # first place of each content of a key
        k = keys[lead]
        start = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        size = np.diff(np.append(start, len(k)))
        src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for m in range(2, few + 1):
            i, j = np.triu_indices(m, 1)
            at = start[size == m][:, None]
            src.append((at + i).ravel())
            dst.append((at + j).ravel())
        hot = np.repeat(size > few, size)
        lone = lead[hot][np.unique(content[lead[hot]], return_index=True)[1]]
        s, d = lead[np.concatenate(src)], lead[np.concatenate(dst)]
        many = np.repeat([False, True], [len(s), len(lone)])
        s, d = np.append(s, lone), np.append(d, lone)
        cols = [many, *(v[i].astype(w) for i in (s, d) for v, w in ((doc, np.int64), (unit, np.int32), (content, np.int64)))]
        return pa.table([pa.array(v) for v in cols], [f.split()[0] for f in _PAIRS.split(", ")])

    return scan.filter(F.col("kind") == _LINES).select("bucket", "keys", "place", "unit", "content", "ids").groupBy("bucket").applyInArrow(run, _PAIRS)


def _answers(scan: DataFrame) -> DataFrame:
    """For each batch of the scan, packed: its pieces (by rank) that a smaller doc_id outside it has, and where."""

    def run(t: pa.Table) -> pa.Table:
        release()
        n = [len(x) // 8 for x in t["keys"].to_pylist()]
        keys = np.concatenate([np.frombuffer(x, "<u8") for x in t["keys"].to_pylist()])
        doc = _owners(t, n)
        start = np.concatenate([_numbers(x, m) for x, m in zip(t["unit"].to_pylist(), n, strict=True)])
        rank = np.concatenate([np.arange(m) + np.frombuffer(x, "<u4")[0] for x, m in zip(t["content"].to_pylist(), n, strict=True)])
        flush = np.repeat(np.array(t["flush"].to_pylist(), np.int64), n)
        order = np.lexsort((start, doc, keys))
        k = keys[order]
        new = np.append(True, k[1:] != k[:-1])
        first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        hit = doc[first] < doc[order]
        at, first = order[hit], first[hit]
        by = np.argsort(flush[at], kind="stable")
        at, first = at[by], first[by]
        cuts = np.flatnonzero(np.diff(flush[at], prepend=-1, append=-1))
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            f = first[a:b]
            out.append((int(flush[at[a]]), *(v.tobytes() for v in (rank[at[a:b]].astype("<u4"), doc[f].astype("<i8"), start[f].astype("<u4")))))
        return pa.table([pa.array([x[i] for x in out], w) for i, w in enumerate((pa.int64(), *[pa.binary()] * 3))], ["flush", "rank", "docs", "starts"])

    keys = scan.filter(F.col("kind") == _PIECES).select("bucket", "flush", "keys", "place", "unit", "content", "ids")
    return keys.groupBy("bucket").applyInArrow(run, "flush long, rank binary, docs binary, starts binary")


_STRETCHES = "doc_id long, row long, start int, stop int, other_doc long, other_start int, other_stop int"


def _stretches(scan: DataFrame, min_words: int) -> DataFrame:
    """Stretches of pieces in a row that follow each other in one document with a smaller doc_id, too;
    without those that could not grow to min_words together with stretches near them."""

    def run(own: pa.Table, found: pa.Table) -> pa.Table:
        release()
        names = [c.split()[0] for c in _STRETCHES.split(", ")]
        if not len(own):
            return pa.table([pa.array([], pa.int32() if "st" in c else pa.int64()) for c in names], names)
        one = {c: own[c][0].as_py() for c in ("keys", "place", "unit", "content", "ids", "rows")}
        rank, words = np.frombuffer(one["keys"], "<u4").astype(np.int64), np.frombuffer(one["unit"], "u1").astype(np.int64)
        ids, rows = (np.frombuffer(one[c], "<i8") for c in ("ids", "rows"))
        n, first = (np.frombuffer(one[c], "<u4").astype(np.int64) for c in ("place", "content"))
        text = np.repeat(np.arange(len(n)), n)
        steps = np.cumsum(words - (SHINGLE - 1)) - (words - (SHINGLE - 1))
        start = steps + np.repeat(first - steps[np.cumsum(n) - n], n)
        doc, row = ids[text], rows[text]
        order = np.lexsort((start, doc, rank))
        r = rank[order]
        lead = order[np.append(True, r[1:] != r[:-1])[: len(r)]]  # ranks are 0, 1, ...
        least, at = doc[lead], start[lead]
        for answers in zip(*(found[c].to_pylist() for c in ("rank", "docs", "starts")), strict=True):
            i = np.frombuffer(answers[0], "<u4")
            least[i], at[i] = (np.frombuffer(x, w) for x, w in zip(answers[1:], ("<i8", "<u4"), strict=True))
        other, other_start = least[rank], at[rank]
        hit = np.flatnonzero(other < doc)
        prev = hit[:-1]
        follows = (hit[1:] == prev + 1) & (text[hit[1:]] == text[prev]) & (other[hit[1:]] == other[prev]) & (other_start[hit[1:]] - other_start[prev] == start[hit[1:]] - start[prev])
        a = np.flatnonzero(np.append(True, ~follows)[: len(hit)])
        b = hit[np.append(a[1:], len(hit)) - 1] if len(hit) else hit
        a = hit[a]
        stop = start[b] + words[b]
        far = np.append(True, (text[a[1:]] != text[a[:-1]]) | (start[a[1:]] > stop[:-1] + 2 * REACH))[: len(a)]
        zone = np.cumsum(far) - 1
        low = start[a][far]
        high = np.maximum.reduceat(stop, np.flatnonzero(far)) if len(a) else stop
        keep = (high - low + 2 * REACH >= min_words)[zone] if len(a) else np.zeros(0, bool)
        a, stop = a[keep], stop[keep]
        cols = [doc[a], row[a], start[a], stop, other[a], other_start[a], other_start[a] + stop - start[a]]
        return pa.table([pa.array(v.astype(np.int32 if "st" in c else np.int64)) for v, c in zip(cols, names, strict=True)], names)

    own = scan.filter(F.col("kind") == _OWN).select("flush", "keys", "place", "unit", "content", "ids", "rows")
    return own.groupBy("flush").cogroup(_answers(scan).groupBy("flush")).applyInArrow(run, _STRETCHES)


def _beside(rows: DataFrame, places: DataFrame) -> DataFrame:
    """The words (hashes) before and behind the places in their documents; once each for rows of one doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                p, out = Paragraphs(part.column("text")), []
                for i, (d, places) in enumerate(zip(*(part.column(c).to_pylist() for c in ("doc_id", "places")), strict=True)):
                    own = p.hash[p.first[i] : p.first[i] + p.size[i]]
                    out += [(d, x["start"], x["stop"], own[max(0, x["start"] - REACH) : x["start"]].tobytes(), own[x["stop"] : x["stop"] + REACH].tobytes()) for x in places]
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], w) for k, w in enumerate(kinds)], ["other_doc", "other_start", "other_stop", "before", "behind"])

    wanted = cut(places.groupBy(F.col("other_doc").alias("doc_id")).agg(F.collect_list(F.struct(F.col("other_start").alias("start"), F.col("other_stop").alias("stop"))).alias("places")))
    texts = picked(rows, wanted, ["doc_id"]).select("doc_id", "text", "places")
    return texts.mapInArrow(run, "other_doc long, other_start int, other_stop int, before binary, behind binary").distinct()


def _grown(rows: DataFrame, stretches: DataFrame) -> DataFrame:
    """doc_id, and the stretches of its rows with the words beside their first places."""
    place = ["other_doc", "other_start", "other_stop"]
    places = cut(stretches.groupBy(*place).agg(F.count(F.lit(1)).alias("n")))
    joined = hot_join(stretches, cut(_beside(rows, places)), place, places)
    return joined.groupBy("doc_id").agg(F.collect_list(F.struct("row", "start", "stop", "other_doc", "before", "behind")).alias("stretches"))


def filled(start: np.ndarray, stop: np.ndarray, percent: int) -> np.ndarray:
    """Which gaps (each after a stretch, the last none) to fill between the stretches that a text and
    one other have in common, in their order.

    A gap of k words changes k + SHINGLE - 1 of the run's shingles; a run of n shingles of which c are
    changed has the Jaccard similarity (n - c) / (n + c). Gaps of a window or more are never filled.
    """
    gap = np.maximum(start[1:] - stop[:-1], 0)
    changed = np.append(0, np.cumsum(np.where(gap < WINDOW, gap + SHINGLE - 1, 1 << 40)))
    high = (100 - percent) * stop - (100 + percent) * changed
    low = (100 - percent) * (start + SHINGLE - 1) - (100 + percent) * changed
    best = np.maximum.accumulate(high[::-1])[::-1]
    last = np.searchsorted(-best, -low, side="right") - 1  # the farthest stretch a similar run from each ends with
    return np.maximum.accumulate(last) > np.arange(len(start))


def covered(words: np.ndarray, stretches: list[dict], percent: int) -> list[tuple[int, int]]:
    """First and end word of what the stretches of a text (hashes of its words) cover, grown and filled."""
    by_other: dict[int, list[tuple[int, int]]] = {}
    for x in stretches:
        start, stop = x["start"], x["stop"]
        before, behind = np.frombuffer(x["before"], "<u8"), np.frombuffer(x["behind"], "<u8")
        m = min(len(before), start)
        if m:
            same = words[start - m : start] == before[len(before) - m :]
            start -= m if same.all() else int(np.argmin(same[::-1]))
        m = min(len(behind), len(words) - stop)
        if m:
            same = words[stop : stop + m] == behind[:m]
            stop += m if same.all() else int(np.argmin(same))
        by_other.setdefault(x["other_doc"], []).append((start, stop))
    out = []
    for spans in by_other.values():
        if len(spans) > 1:
            spans = sorted(set(spans))
            start, stop = (np.array(v, np.int64) for v in zip(*spans, strict=True))
            stop = np.maximum.accumulate(stop)
            fill = filled(start, stop, percent)
            stop[:-1] = np.where(fill[:-1], np.maximum(stop[:-1], start[1:]), stop[:-1])
            spans = list(zip(start.tolist(), stop.tolist(), strict=True))
        out += spans
    return out


def _line_sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, tokens: shingle sets of the lines wanted (doc_id, lines of unit, content and node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                p = Paragraphs(part.column("text"))
                nodes = [{(x["unit"], x["content"]): x["node"] for x in v} for v in part.column("lines").to_pylist()]
                key, of = p.shingles()
                start = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)])
                ends = np.append(start[1:], len(of))
                text, name = p.line_text[of[start]].tolist(), zip(p.line_no[of[start]].tolist(), p.names()[of[start]].tolist(), strict=True)
                out = [(nodes[t][u], np.unique(key[a:b]).tobytes()) for a, b, t, u in zip(start, ends, text, name, strict=True) if u in nodes[t]]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["node", "tokens"])

    return picked(rows, wanted, ["doc_id"]).select("text", "lines").mapInArrow(run, "node long, tokens binary").dropDuplicates(["node"])


def _by_document(lines: DataFrame) -> DataFrame:
    return cut(lines.groupBy("doc_id").agg(F.collect_list(F.struct("unit", "content", "node")).alias("lines")))


def _verified(rows: DataFrame, pairs: DataFrame, ends: DataFrame, percent: int) -> DataFrame:
    """src, dst: those pairs of lines (nodes) whose shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("tokens", "other_tokens"))
            ok = [links(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(a, b, strict=True)]
            yield batch.select(["src", "dst"]).filter(pa.array(ok, pa.bool_()))

    sets = cut(_line_sets(rows, _by_document(ends)))
    mine, other = sets.withColumnRenamed("node", "src"), sets.select(F.col("node").alias("dst"), F.col("tokens").alias("other_tokens"))
    both = pairs.join(mine, "src").join(other, "dst")
    return both.select("src", "dst", "tokens", "other_tokens").mapInArrow(run, "src long, dst long")


def _line_texts(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id (the line's node) and text of lines (doc_id, unit, content, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                p = Paragraphs(part.column("text"))
                have = set(zip(p.line_text.tolist(), p.line_no.tolist(), p.names().tolist(), strict=True))
                nodes, texts = [], []
                for i, (text, wanted) in enumerate(zip(part.column("text").to_pylist(), part.column("lines").to_pylist(), strict=True)):
                    split = text.split("\n")
                    wanted = [x for x in wanted if (i, x["unit"], x["content"]) in have]
                    nodes += [x["node"] for x in wanted]
                    texts += [split[x["unit"]] for x in wanted]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    texts = picked(rows, _by_document(lines), ["doc_id"])
    return cut(texts.select("text", "lines").mapInArrow(run, "doc_id long, text string").dropDuplicates(["doc_id"]))


def _seen_lines(scan: DataFrame) -> DataFrame:
    """content, doc_id, unit of all lines that have band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, place, unit, ids in zip(*(batch.column(c).to_pylist() for c in ("keys", "place", "unit", "ids")), strict=True):
                doc = np.frombuffer(ids, "<i8")[np.frombuffer(place, "<u4")]
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, "<i8")), pa.array(doc), pa.array(np.frombuffer(unit, "<i4"))], ["content", "doc_id", "unit"])

    return scan.filter(F.col("kind") == _SEEN).select("keys", "place", "unit", "ids").mapInArrow(run, "content long, doc_id long, unit int")


def _repeated_lines(rows: DataFrame, scan: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """doc_id, lines: all lines (unit, content) equal or similar to one of a smaller doc_id."""
    first = ["doc_id", "unit", "content"]
    pairs = cut(found.filter("not many").drop("many").distinct())
    ends = cut(pairs.select(*first).union(pairs.select("other_doc", "other_unit", "other_content")).distinct().withColumn("node", F.col("content")))
    edges = cut(_verified(rows, pairs.select(F.col("content").alias("src"), F.col("other_content").alias("dst")), ends, percent))
    many = cut(found.filter("many").select(*first).distinct().withColumn("node", F.col("content")))
    if not many.isEmpty():
        joined = jaccard_join.join(_line_texts(rows, many), percent).filter("component_id <> doc_id")
        edges = edges.union(joined.select("doc_id", "component_id"))
    placed = cut(components(edges).select(F.col("node").alias("content"), "component"))
    seen = cut(_seen_lines(scan))
    known = seen.groupBy("content").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n"))
    near = cut(known.join(placed, "content"))
    least = cut(near.groupBy("component").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("n")))
    near = hot_join(near, least.select("component", "first"), ["component"], least.select("component", "n")).select("content", "first", "most", "n")
    again = known.filter("most > least").join(placed, "content", "left").filter("component is null")
    equal = again.select("content", F.col("least").alias("first"), "most", "n")
    repeated = cut(near.union(equal).filter("most > first").drop("most"))
    every = hot_join(seen, repeated.select("content", "first"), ["content"], repeated.select("content", "n"))
    return every.filter("doc_id > first").groupBy("doc_id").agg(F.collect_set(F.struct("unit", "content")).alias("lines"))


def repeats(docs: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, keys_per_bucket: int = 200_000) -> DataFrame:
    """doc_id, lines (number and content of repeated ones), stretches (of words of a row, with what is
    beside them at their first place) of the documents that have any."""
    rows = _rows_of(docs)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # a line of 200 bytes has 6 keys, a piece is 40 bytes or so
    scan = cut(_scan(rows, max(8, round(size / 36 / keys_per_bucket)), max(8, round(size / 40 / keys_per_bucket))))
    lines = _repeated_lines(rows, scan, cut(_line_pairs(scan)), percent)
    return lines.join(_grown(rows, cut(_stretches(scan, min_words))), "doc_id", "full")


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def removed_words(p: Paragraphs, names: np.ndarray, text: int, lines: list[dict], stretches: list[dict], percent: int, min_words: int) -> list[tuple[int, int]]:
    """Runs (first word, end) of one text to remove."""
    a = int(p.first[text])
    hit = np.zeros(int(p.size[text]), np.int8)
    x, y = np.searchsorted(p.line_text, [text, text + 1])
    wanted = {(line["unit"], line["content"]) for line in lines}
    for k in (k for k in range(x, y) if (int(p.line_no[k]), int(names[k])) in wanted) if wanted else ():
        hit[p.line_start[k] - a : p.line_start[k] - a + p.line_size[k]] = 1
    for s, e in covered(p.hash[a : a + len(hit)], stretches, percent):
        hit[s:e] = 1
    edge = np.flatnonzero(np.diff(hit, prepend=0, append=0))
    return [(int(s), int(e)) for s, e in zip(edge[::2], edge[1::2], strict=True) if e - s >= min_words]


def without(text: str, runs: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """text without the runs of words (and the space before each), and the character spans removed."""
    at = [m.span() for m in _WORD.finditer(text)]
    spans = [(at[s - 1][1] if s else 0, at[e - 1][1]) for s, e in runs]
    kept, last = [], 0
    for s, e in spans:
        kept.append(text[last:s])
        last = e
    return "".join([*kept, text[last:]]), spans


def dedup(docs: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text cleaned, and n_words, n_removed_words, spans (removed, in characters)."""
    found = cut(repeats(docs, percent, min_words))
    schema = docs.schema
    keep = [c for c in docs.columns if c not in ("text", "n_words", "n_removed_words", "spans")]
    extra = "n_words long, n_removed_words long, spans array<struct<start:int,stop:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                texts = part.column("text").to_pylist()
                n = np.bincount(words_of(part.column("text"))[1], minlength=len(texts))
                spans: list[list] = [[] for _ in texts]
                gone = [0] * len(texts)
                lines, stretches, row = (part.column(c).to_pylist() for c in ("__lines", "__stretches", "__row"))
                marked = [i for i, (x, y) in enumerate(zip(lines, stretches, strict=True)) if x or y]
                p = Paragraphs(part.column("text").take(pa.array(marked, pa.int64())))
                names = p.names()
                for k, i in enumerate(marked):
                    own = [x for x in stretches[i] or () if x["row"] == row[i]]
                    runs = removed_words(p, names, k, lines[i] or [], own, percent, min_words)
                    if runs:
                        texts[i], spans[i] = without(texts[i], runs)
                        gone[i] = sum(e - s for s, e in runs)
                new = pa.array([[{"start": s, "stop": e} for s, e in x] for x in spans], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
                cols = [pa.array(texts, pa.string()), *(part.column(c) for c in keep), pa.array(n.astype(np.int64)), pa.array(gone, pa.int64()), new]
                yield pa.RecordBatch.from_arrays(cols, ["text", *keep, "n_words", "n_removed_words", "spans"])

    marks = found.withColumnsRenamed({c: f"__{c}" for c in found.columns})
    rows = docs.withColumns({"__doc_id": F.col("doc_id").cast("long"), "__row": F.xxhash64("text")})
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [schema["text"], *(schema[c] for c in keep)])
    return marked_rows(rows, marks, "__doc_id").select("text", *keep, "__row", "__lines", "__stretches").mapInArrow(run, f"{fields}, {extra}")


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    from weftline.llm.common import table

    out = dedup(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return out.select("doc_id", "n_words", "n_removed_words", F.size("spans").cast("long").alias("n_spans"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
