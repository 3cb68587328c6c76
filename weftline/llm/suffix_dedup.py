"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` bytes that a smaller doc_id has too.

1. Anchors. In every string of 50 bytes the 16-byte gram with the least hash is an anchor, wherever
   the string stands; so equal strings have equal anchors. Anchors (one in 18 bytes) travel as packed
   sorted keys; those that two documents or more have are shared.
2. Shards. Each shared anchor's context (34 bytes before it, 50 from it) goes to the shard of its
   key. A shard keeps each distinct context once with its least doc_id. Keys whose contexts are all
   equal are settled, and contexts that share neither the 17 bytes before nor those behind the anchor
   with another one of the key; the others form the shard's text. Its suffix array is built by
   Larsson-Sadakane refinement in numpy (ranks doubled, only groups not yet single are sorted again,
   up to 50 bytes), with common prefixes on which all suffixes advance together (common_prefixes).
   Runs of suffixes with a common prefix of 50 bytes are equal strings; each run's least doc_id
   decides. A shard of more than ``shard_bytes`` is cut into several arrays between keys; a key of more
   contexts than an array takes is cut too, and its arrays' strings meet by hash. Anchors and contexts
   are held over many texts before they are dealt, so that shuffled rows grow with the input only.
3. The spans so found are joined to their documents, merged, and cut out.

Exact copies of a text are settled first: all their strings start in the copy with the least doc_id.
Null texts are empty. Rows without doc_id are compared with nothing and keep all their bytes. Every
row of a repeated doc_id is judged by its own text, against rows of smaller doc_ids only. Extra
columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut, mix64, release, slices, small_side, text_or_empty
from weftline.llm.jaccard_join import KEY_BYTES, pack_keys, unpack_keys

LENGTH, GRAM = 50, 16
SPAN = LENGTH - GRAM + 1  # grams in a string
BEFORE = LENGTH - GRAM
CONTEXT = BEFORE + LENGTH
GAP = 0xFF  # never a byte of UTF-8
_MASK = np.uint64((1 << 8 * KEY_BYTES) - 1)
_TOP = np.uint64(2**64 - 1)


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) of each run of width values."""
    done = 1
    while 2 * done <= width:
        x = best(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return best(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in data (joined texts that begin at start and have size bytes) of anchors, and their keys."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    v = data.astype(np.uint64)
    for k in (1, 2, 4):
        v = v[:-k] | (v[k:] << np.uint64(8 * k))
    h = mix64(mix64(v[:-8]) + v[8:])  # one for each place up to n - GRAM
    place = np.arange(n, dtype=np.int64)
    ends = np.repeat(start + size, size)  # texts lie one behind the other
    fits = place[: len(h)] + GRAM <= ends[: len(h)]
    h[~fits] = _TOP
    low = _sliding(h, SPAN, np.minimum)  # of the string that begins there
    low[place[: len(low)] + LENGTH > ends[: len(low)]] = 0
    wide = np.zeros(len(h) + SPAN - 1, np.uint64)
    wide[SPAN - 1 : SPAN - 1 + len(low)] = low
    at = np.flatnonzero((_sliding(wide, SPAN, np.maximum) == h) & fits)
    return at, h[at] & _MASK


def _eights(text: np.ndarray, more: int = 0) -> np.ndarray:
    """The eight bytes from each place as one number, first byte highest; zeros beyond the end."""
    v = np.zeros(len(text) + more + 8, np.uint64)
    v[: len(text)] = text
    for k in (1, 2, 4):
        v[:-k] = (v[:-k] << np.uint64(8 * k)) | v[k:]
    return v


def suffix_array(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffixes of text in the order of their first depth bytes or more (ties by place).

    Larsson-Sadakane: the order by 8 bytes first; then, with ranks known for h bytes, only suffixes
    in groups of equal rank are sorted by the rank h places on, which doubles h.
    """
    n = len(text)
    key = _eights(text)[:n]
    sa = np.argsort(key)
    new = np.append(True, key[sa][1:] != key[sa][:-1])
    rank = np.empty(n, np.int64)
    rank[sa] = np.flatnonzero(new)[np.cumsum(new) - 1]
    h = 8
    while h < depth:
        first = np.append(new, True)
        multi = np.flatnonzero(~(first[:-1] & first[1:]))  # places in sa of groups of two or more
        if not len(multi):
            break
        s = sa[multi]
        nxt = np.where(s + h < n, rank[np.minimum(s + h, n - 1)], -1)
        group = rank[s]
        order = np.argsort(group * (n + 1) + nxt + 1)
        sa[multi] = s[order]
        g, x = group[order], nxt[order]
        split = np.append(True, (g[1:] != g[:-1]) | (x[1:] != x[:-1]))
        new[multi] |= split
        rank[sa] = np.flatnonzero(new)[np.cumsum(new) - 1]
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Common prefix, up to most bytes, of each suffix with the one before it in sa (first: 0).

    Kasai's bound (a suffix shares with its neighbour at least what the suffix one place to its left
    shares, less one) makes prefixes cheap to carry on from; here all suffixes advance together
    instead, eight bytes a step, so that a step is a few array operations.
    """
    n = len(text)
    out = np.zeros(n, np.int64)
    v = _eights(text, most)
    run, done = np.arange(1, n), 0
    while len(run) and done < most:
        x = v[sa[run] + done] ^ v[sa[run - 1] + done]
        more = np.full(len(x), 8)
        odd = x != 0
        y = x[odd]
        more[odd] = sum((y < np.uint64(1 << (64 - 8 * j))).astype(np.int64) for j in range(1, 8))
        out[run] = done + more
        run = run[~odd]
        done += 8
    room = n - np.maximum(sa[1:], sa[:-1])
    out[1:] = np.minimum(np.minimum(out[1:], room), most)
    return out


def least_owner(contexts: np.ndarray, least: np.ndarray) -> np.ndarray:
    """(contexts, SPAN): for every string of LENGTH bytes in the contexts the least owner of an equal
    string in any of them; strings with a gap: the greatest integer."""
    n, width = contexts.shape
    none = np.iinfo(np.int64).max
    text = np.full((n, width + 1), GAP, np.uint8)
    text[:, :width] = contexts
    text = text.reshape(-1)
    gaps = np.concatenate([[0], np.cumsum(text == GAP)])
    sa = suffix_array(text)
    lcp = common_prefixes(text, sa)
    valid = np.zeros(len(text), bool)
    valid[: len(text) - LENGTH + 1] = gaps[LENGTH:] == gaps[: len(text) - LENGTH + 1]
    start = np.flatnonzero(np.append(True, lcp[1:] < LENGTH))
    owner = np.where(valid[sa], least[sa // (width + 1)], none)
    best = np.repeat(np.minimum.reduceat(owner, start), np.diff(np.append(start, len(sa))))
    out = np.full(len(text), none, np.int64)
    out[sa] = best
    out[~valid] = none
    return out.reshape(n, width + 1)[:, :SPAN]


def _row_hashes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes as rows of 64-bit words, zeros behind, and a hash of each."""
    n, width = rows.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = rows
    words = words.view("<u8")
    h = np.zeros(n, np.uint64)
    for k in range(words.shape[1]):
        h = mix64(h + words[:, k])
    return words, h


def alike(rows: np.ndarray) -> np.ndarray:
    """A number for each of the rows (n, width bytes), the same where all bytes are."""
    words, h = _row_hashes(rows)
    order = np.argsort(h)
    new = np.append(True, h[order][1:] != h[order][:-1])[: len(h)]
    by = words[order]
    if ((by[1:] != by[:-1]).any(axis=1) & ~new[1:]).any():  # different rows with one hash
        return np.unique(words, axis=0, return_inverse=True)[1].reshape(-1)
    out = np.empty(len(h), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def may_meet(contexts: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which of the contexts (all different) may share a string with another of their key: a string holds
    the anchor and all of the 17 bytes before it or of the 17 behind it."""
    out = np.zeros(len(contexts), bool)
    half = (LENGTH - GRAM) // 2
    wide = np.zeros((len(contexts), 8 + GRAM + half), np.uint8)
    wide[:, :8] = np.ascontiguousarray(key).view(np.uint8).reshape(-1, 8)
    for a in (BEFORE - half, BEFORE):
        wide[:, 8:] = contexts[:, a : a + GRAM + half]
        of = alike(wide)
        out |= np.bincount(of, minlength=1)[of] > 1
    return out


def _merged(contexts: np.ndarray, least: np.ndarray, step: int) -> np.ndarray:
    """least_owner over more contexts than an array takes: arrays of step contexts, whose strings meet in the
    order of their hashes, some at a time. The work is in proportion to the contexts."""
    own = np.concatenate([least_owner(contexts[a : a + step], least[a : a + step]) for a in range(0, len(contexts), step)])
    strings, flat = np.lib.stride_tricks.sliding_window_view(contexts, LENGTH, axis=1), own.reshape(-1)
    h = np.stack([_row_hashes(contexts[:, s : s + LENGTH])[1] for s in range(SPAN)], axis=1).reshape(-1)
    order = np.argsort(h)
    starts = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
    edges = np.append(starts[np.unique(np.searchsorted(starts, np.arange(0, starts[-1] + 1, 1 << 20)))], len(order))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        r = order[a:b]
        of = alike(strings[r // SPAN, r % SPAN])
        best = np.full(of.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(best, of, flat[r])
        flat[r] = best[of]
    return own


def merged_owners(contexts: np.ndarray, least: np.ndarray, shard_bytes: int, key: np.ndarray | None = None) -> np.ndarray:
    """least_owner over any number of contexts in the order of their keys (none given: one key): arrays of
    bounded size hold whole keys, whose strings differ from all other keys' strings."""
    step, n = max(1, shard_bytes // (CONTEXT + 1)), len(contexts)
    if n <= step:
        return least_owner(contexts, least)
    ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, n) if key is not None else np.array([n])
    out, a = [], 0
    while a < n:
        b = int(ends[max(np.searchsorted(ends, a + step, side="right") - 1, np.searchsorted(ends, a, side="right"))])
        out.append(least_owner(contexts[a:b], least[a:b]) if b - a <= step else _merged(contexts[a:b], least[a:b], step))
        a = b
    return np.concatenate(out)


_BLOBS = "bucket long, keys binary, owners binary, places binary, ids binary, rows binary"


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size


#: Anchors, and contexts, that a task of a scan holds before it deals them out: with rows for each slice of
#: text and bucket, their number would grow with the square of the input.
HELD_ANCHORS, HELD_CONTEXTS = 1 << 19, 1 << 17


def _squeezed(x: np.ndarray) -> bytes:
    """Numbers by bytes of equal weight, or bytes, compressed; before them how many bytes they take."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _opened(data: bytes, kind: str) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(pa.decompress(data[8:], n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _dealt(of: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, its places in keys by key) for each bucket of of."""
    order = np.lexsort((keys, of))
    cuts = np.flatnonzero(np.diff(of[order], prepend=-1, append=-1))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(of[order[a]]), order[a:b]


def _batch(made: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], pa.binary() if i else pa.int64()) for i in range(len(names))], names)


def _batches(made: Iterator[tuple], names: list[str], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for m in made:
        held.append(m)
        size += sum(map(len, m[1:]))
        if size >= most:
            yield _batch(held, names)
            held, size = [], 0
    if held:
        yield _batch(held, names)


def _anchor_scan(docs: DataFrame, buckets: int) -> DataFrame:
    names = ["bucket", "keys", "owners", "places", "ids", "rows"]

    def pack(held: list[tuple]) -> Iterator[tuple]:
        keys, doc, place, ids, rows = (np.concatenate(x) for x in zip(*held, strict=True))
        for bucket, r in _dealt((keys % np.uint64(buckets)).astype(np.int64), keys):
            used, local = np.unique(doc[r], return_inverse=True)
            yield bucket, pack_keys(keys[r]), _squeezed(local.astype("<u4")), _squeezed(place[r].astype("<u4")), _squeezed(ids[used].astype("<i8")), _squeezed(rows[used].astype("<i8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, texts = [], 0, 0
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                data, start, size = _joined([t.encode() for t in part.column("text").to_pylist()])
                at, keys = anchors(data, start, size)
                if not len(at):
                    continue
                ids, rows = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "row"))
                doc = np.searchsorted(start + size, at, side="right")
                held.append((keys, doc + texts, at - start[doc], ids, rows))
                n, texts = n + len(at), texts + len(ids)
                if n >= HELD_ANCHORS:
                    yield from _batches(pack(held), names)
                    held, n, texts = [], 0, 0
        if held:
            yield from _batches(pack(held), names)
            held.clear()
        release()

    return docs.select("doc_id", "row", "text").mapInArrow(run, _BLOBS)


def _shared(scan: DataFrame, homes: int) -> DataFrame:
    """doc_id, row, places: anchors of each row that rows of another doc_id have too; gathered in homes groups."""

    def run(t: pa.Table) -> pa.Table:
        keys = np.concatenate([unpack_keys(x) for x in t["keys"].to_pylist()])
        owners = [_opened(x, "<u4") for x in t["owners"].to_pylist()]
        doc, row = (np.concatenate([_opened(x, "<i8")[o] for x, o in zip(t[c].to_pylist(), owners, strict=True)]) for c in ("ids", "rows"))
        place = np.concatenate([_opened(x, "<u4") for x in t["places"].to_pylist()])
        order = np.argsort(keys, kind="stable")
        k, d = keys[order], doc[order]
        start = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        two = np.repeat(np.minimum.reduceat(d, start) != np.maximum.reduceat(d, start), np.diff(np.append(start, len(k))))
        d, r, p = d[two], row[order][two], place[order][two]
        to = (mix64(d.astype(np.uint64)) % np.uint64(homes)).astype(np.int64)
        by = np.lexsort((r, d, to))
        cuts = np.flatnonzero(np.diff(to[by], prepend=-1, append=-1))
        made = [(int(to[by[a]]), d[by[a:b]].astype("<i8").tobytes(), r[by[a:b]].astype("<i8").tobytes(), p[by[a:b]].astype("<u4").tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table([pa.array([m[i] for m in made], k) for i, k in enumerate((pa.int64(), *[pa.binary()] * 3))], ["bucket", "docs", "rows", "places"])

    def gather(t: pa.Table) -> pa.Table:
        d, r = (np.concatenate([np.frombuffer(x, "<i8") for x in t[c].to_pylist()]) for c in ("docs", "rows"))
        p = np.concatenate([np.frombuffer(x, "<u4") for x in t["places"].to_pylist()])
        by = np.lexsort((r, d))
        d, r, p = d[by], r[by], p[by]
        cuts = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (r[1:] != r[:-1])))
        return pa.table([pa.array(d[cuts]), pa.array(r[cuts]), pa.array([np.unique(x).astype("<u4").tobytes() for x in np.split(p, cuts[1:])], pa.binary())], ["doc_id", "row", "places"])

    packed = scan.groupBy("bucket").applyInArrow(run, "bucket long, docs binary, rows binary, places binary")
    return packed.groupBy("bucket").applyInArrow(gather, "doc_id long, row long, places binary")


_CONTEXTS = "bucket long, keys binary, places binary, docs binary, rows binary, contexts binary"


def _contexts(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed contexts of shared anchors by bucket; docs has doc_id, row, text, places."""

    names = ["bucket", "keys", "places", "docs", "rows", "contexts"]

    def pack(held: list[tuple]) -> Iterator[tuple]:
        keys, place, doc, row, ctx = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        for bucket, r in _dealt((keys % np.uint64(buckets)).astype(np.int64), keys):
            yield bucket, pack_keys(keys[r]), _squeezed(place[r].astype("<u4")), _squeezed(doc[r].astype("<i8")), _squeezed(row[r].astype("<i8")), _squeezed(ctx[r].reshape(-1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                data, start, size = _joined([t.encode() for t in part.column("text").to_pylist()])
                ids, rows = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "row"))
                lists = [np.frombuffer(x, "<u4").astype(np.int64) for x in part.column("places").to_pylist()]
                doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                if not len(doc):
                    continue
                place = np.concatenate(lists)
                at = place + start[doc]
                v = np.zeros(len(at), np.uint64)
                w = np.zeros(len(at), np.uint64)
                for k in range(8):
                    v |= data[at + k].astype(np.uint64) << np.uint64(8 * k)
                    w |= data[at + 8 + k].astype(np.uint64) << np.uint64(8 * k)
                keys = mix64(mix64(v) + w) & _MASK
                for a in range(0, len(at), 20_000):
                    r = slice(a, a + 20_000)
                    spot = at[r][:, None] + np.arange(-BEFORE, LENGTH)
                    inside = (spot >= start[doc[r]][:, None]) & (spot < (start + size)[doc[r]][:, None])
                    ctx = np.where(inside, data[np.clip(spot, 0, len(data) - 1)], np.uint8(GAP))
                    held.append((keys[r], place[r].astype(np.uint32), ids[doc[r]], rows[doc[r]], ctx))
                    n += len(ctx)
                    if n >= HELD_CONTEXTS:
                        yield from _batches(pack(held), names)
                        held, n = [], 0
        if held:
            yield from _batches(pack(held), names)
        release()

    return docs.select("doc_id", "row", "text", "places").mapInArrow(run, _CONTEXTS)


def _spans(contexts: DataFrame, shard_bytes: int) -> DataFrame:
    """doc_id, row, start, stop (bytes) that the anchors of each bucket give."""

    def run(t: pa.Table) -> pa.Table:
        keys = np.concatenate([unpack_keys(x) for x in t["keys"].to_pylist()])
        doc, row = (np.concatenate([_opened(x, "<i8") for x in t[c].to_pylist()]) for c in ("docs", "rows"))
        place = np.concatenate([_opened(x, "<u4") for x in t["places"].to_pylist()]).astype(np.int64)
        ctx = np.concatenate([_opened(x, "u1") for x in t["contexts"].to_pylist()]).reshape(-1, CONTEXT)
        of = alike(ctx)  # equal contexts have one key
        one = np.empty(of.max() + 1, np.int64)
        one[of] = np.arange(len(of))
        texts, key = ctx[one], keys[one]
        del ctx
        least = np.full(len(texts), np.iinfo(np.int64).max)
        np.minimum.at(least, of, doc)
        of_key = np.unique(key, return_inverse=True)[1]
        mixed = np.flatnonzero(np.bincount(of_key)[of_key] > 1)
        mixed = mixed[may_meet(texts[mixed], key[mixed])]
        mixed = mixed[np.argsort(of_key[mixed], kind="stable")]
        slot = np.full(len(texts), -1, np.int64)
        slot[mixed] = np.arange(len(mixed))
        own = merged_owners(texts[mixed], least[mixed], shard_bytes, of_key[mixed]) if len(mixed) else np.zeros((1, SPAN), np.int64)
        found = []
        for a in range(0, len(doc), 20_000):
            c, d, at = of[a : a + 20_000], doc[a : a + 20_000], place[a : a + 20_000]
            gap = np.concatenate([np.zeros((len(c), 1), np.uint8), np.cumsum(texts[c] == GAP, axis=1, dtype=np.uint8)], axis=1)
            hit = (least[c] < d)[:, None] & (gap[:, LENGTH:] == gap[:, : CONTEXT - LENGTH + 1])
            m = slot[c] >= 0
            hit[m] = own[slot[c[m]]] < d[m][:, None]
            edge = np.diff(hit.astype(np.int8), axis=1, prepend=0, append=0)
            i, s = np.nonzero(edge == 1)
            e = np.nonzero(edge == -1)[1]
            found.append((d[i], row[a : a + 20_000][i], at[i] - BEFORE + s, at[i] - BEFORE + e - 1 + LENGTH))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["doc_id", "row", "start", "stop"])

    return contexts.groupBy("bucket").applyInArrow(run, "doc_id long, row long, start long, stop long")


def _apply(docs: DataFrame) -> DataFrame:
    """Cuts spans out; docs has doc_id, text, cutting (array of struct start, stop), copy (boolean)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                n_bytes, removed, n_spans, kept, spans = [], [], [], [], []
                for t, cutting, copy in zip(part.column("text").to_pylist(), part.column("cutting").to_pylist(), part.column("copy").to_pylist(), strict=True):
                    data = t.encode()
                    runs: list[list[int]] = [[0, len(data)]] if copy and len(data) >= LENGTH else []
                    if not runs:
                        for c in sorted((c["start"], c["stop"]) for c in cutting or ()):
                            if runs and c[0] <= runs[-1][1]:
                                runs[-1][1] = max(runs[-1][1], c[1])
                            else:
                                runs.append(list(c))
                    out, last = [], 0
                    for s, e in runs:
                        out.append(data[last:s])
                        last = e
                    out.append(data[last:])
                    kept.append(b"".join(out))
                    n_bytes.append(len(data))
                    removed.append(len(data) - len(kept[-1]))
                    n_spans.append(len(runs))
                    spans.append([{"start": s, "stop": e} for s, e in runs])
                kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
                cols = [part.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return docs.select("doc_id", "text", "cutting", "copy").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,stop:long>>, kept binary")


def _with_row(rows: DataFrame, again: DataFrame, name: str) -> DataFrame:
    """rows with row: a hash of the text (name: the text, or its hash) where texts differ under one doc_id, else 0."""
    if again.isEmpty():
        return rows.withColumn("row", F.lit(0).cast("long"))
    own = F.col(name) if name == "a" else F.xxhash64(name)
    return rows.join(small_side(again.withColumn("many", F.lit(True)), 24), "doc_id", "left").withColumn("row", F.when(F.col("many"), own).otherwise(F.lit(0).cast("long"))).drop("many")


def dedup(docs: DataFrame, anchors_per_bucket: int = 400_000, shard_bytes: int = 2 << 20, contexts_per_bucket: int = 25_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans, kept (bytes) of each row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(8, round(size / 18 / anchors_per_bucket))
    signed = docs.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("a"), F.crc32(F.col("text").cast("binary")).alias("b"), F.octet_length("text").alias("n"))
    again = cut(signed.groupBy("doc_id").agg(F.min("a").alias("x"), F.max("a").alias("y")).filter("x <> y").select("doc_id"))
    docs, signed = (_with_row(x, again, name) for x, name in ((docs, "text"), (signed, "a")))
    copies = cut(signed.groupBy("a", "b", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m"))
    copies = cut(signed.filter(f"n >= {LENGTH}").join(small_side(copies, 64), ["a", "b", "n"]).filter("doc_id <> rep").select("doc_id", "row").distinct())
    first = docs.filter("doc_id is not null").join(small_side(copies, 32), ["doc_id", "row"], "left_anti")
    shared = cut(_shared(_anchor_scan(first, buckets), max(8, buckets // 4)))
    met = shared.agg(F.coalesce(F.sum(F.octet_length("places")), F.lit(0))).first()[0] // 4
    spans = cut(_spans(_contexts(first.join(shared, ["doc_id", "row"]), max(64, round(met / contexts_per_bucket))), shard_bytes))
    cutting = spans.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "stop")).alias("cutting"))
    marks = cutting.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)), allowMissingColumns=True)
    return _apply(docs.join(marks, ["doc_id", "row"], "left"))


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    from weftline.llm.common import table

    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
