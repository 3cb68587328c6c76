"""N-gram Jaccard join by token groups.

A document's set is that of its distinct 5-word shingles. Documents link when the Jaccard
similarity of their sets is at least ``percent`` / 100. The join returns components of links, and
finds every link between different components, so no component is missed:

1. Sets are hashed; equal sets form one class, and only classes go on.
2. Filter. With tokens in hash order, two sets that link share at least ``l`` of their first
   ``n - t + l`` tokens (t: least overlap of a set of n). Sets fewer of whose first tokens occur in
   any other set link with nothing and end here. Tokens travel as packed sorted keys, a few bytes
   each.
3. Grouping. The rest is grouped by minimum tokens, large groups in blocks; within a block each set
   is compared with the block's cluster leaders. Clusters that share members are joined. Groups
   so made hold similar documents; thousands of near copies end in one group.
4. Token-group matrix. Each group's token union is kept as (token, group) rows, for tokens in two
   groups or more. A set with fewer than t such tokens ends here. With a set's tokens rarest first,
   a group that has none of the first c - t + 1 of its c tokens can share at most t - 1, too few;
   the other groups qualify, if their sizes do, are opened, and the set is verified against their
   members.

Words are runs of other than ASCII white space, A-Z lower-cased. A text of one to four words has one
shingle, the whole of it; null, empty and blank texts have none and link with nothing. Rows without
doc_id are not linked and have no component. Repeated rows and equal texts are in one component.
Shingles are compared by 64-bit hashes. Extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import cut, hash_words, mix64, release, slices, small_side, whole, words_of
from weftline.llm.components import components

SIZE, PERCENT = 5, 75
KEY_BYTES = 6
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, size: int = SIZE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    flat, row = words_of(pc.ascii_lower(whole(texts)))
    h = hash_words(flat)
    n = max(0, len(h) - size + 1)
    key = np.zeros(n, np.uint64)
    for k in range(size):
        key = mix64(key * _STEP + h[k : n + k])
    inside = row[:n] == row[size - 1 :][:n]
    count = np.bincount(row, minlength=len(texts))
    end = np.cumsum(count)
    out = []
    for a, b in zip(end - count, end, strict=True):
        if b - a >= size:
            out.append(np.unique(key[a : b - size + 1][inside[a : b - size + 1]]))
        elif b > a:
            one = np.uint64(b - a)
            for x in h[a:b]:
                one = mix64(np.array([(int(one) * int(_STEP) + int(x)) % 2**64], np.uint64))[0]
            out.append(np.array([one], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """The fewest tokens a set of n shares with any set it links with."""
    return -(-percent * n // 100)


def shared(n: int, percent: int = PERCENT, part: float = 0.1, least: int = 24) -> int:
    """l above, for a set of n: a tenth of it, more for small sets, whose tokens are few anyway."""
    return max(1, min(least_overlap(n, percent), max(int(part * n), least)))


def first_tokens(tokens: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    n = len(tokens)
    return tokens[: n - least_overlap(n, percent) + shared(n, percent)]


def needed(n: int, percent: int = PERCENT) -> int:
    """First tokens that a set of n shares with any set it links with: those have size t or more."""
    return shared(least_overlap(n, percent), percent)


def links(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def pack_keys(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, KEY_BYTES)
    return out.view("<u8").reshape(-1)


MANY = 0xFFFFFFFF  # the owner of a key that several documents have, which are counted already


def bucket_rows(keys: np.ndarray, owner: np.ndarray, ids: np.ndarray, buckets: int) -> Iterator[tuple]:
    """(bucket, packed sorted keys, owners as places in ids or MANY, ids) of the keys of some documents."""
    keys = keys & np.uint64((1 << 8 * KEY_BYTES) - 1)
    order = np.argsort(keys % np.uint64(buckets), kind="stable")
    keys, owner = keys[order], owner[order]
    of = (keys % np.uint64(buckets)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(of, prepend=-1, append=-1))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        inner = np.argsort(keys[a:b], kind="stable")
        used, place = np.unique(owner[a:b][inner], return_inverse=True)
        if used[-1] == MANY:
            used = used[:-1]
            place = np.where(place == len(used), MANY, place)
        yield int(of[a]), pack_keys(keys[a:b][inner]), place.astype("<u4").tobytes(), ids[used].astype("<i8").tobytes()


def combined(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key once, its owner (MANY if several of the n have it), and how many such keys each has.

    So a key of a third of all documents is sent on once for each call, not once for each document.
    """
    keys = keys & np.uint64((1 << 8 * KEY_BYTES) - 1)
    order = np.argsort(keys, kind="stable")
    k, o = keys[order], owner[order]
    start = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    size = np.diff(np.append(start, len(k)))
    count = np.bincount(o[np.repeat(size > 1, size)], minlength=n)
    return k[start], np.where(size > 1, MANY, o[start]), count


def shared_keys(rows: list[tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and, for each, how many of its keys a bucket has from two or more ids or rows.

    Documents behind the owner MANY are counted where their keys were combined.
    """
    keys = np.concatenate([unpack_keys(r[0]) for r in rows])
    tables = [np.frombuffer(r[2], "<i8") for r in rows]
    base = np.cumsum([0, *map(len, tables)])
    ids = np.concatenate(tables)
    places = [np.frombuffer(r[1], "<u4").astype(np.int64) for r in rows]
    owner = np.concatenate([np.where(p == MANY, len(ids), p + b) for p, b in zip(places, base, strict=False)])
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    twice = np.zeros(len(k), bool)
    twice[1:] |= same
    twice[:-1] |= same
    count = np.bincount(owner[order][twice], minlength=len(ids) + 1)[:-1]
    return ids[count > 0], count[count > 0]


_BLOBS = "bucket long, keys binary, owners binary, ids binary, sigs binary"


def _scan(docs: DataFrame, buckets: int, percent: int, flush: int = 1_000_000) -> DataFrame:
    """Packed first tokens by bucket; bucket -1 and less: sizes and signatures of all documents, and
    (sigs null) counts of first tokens combined before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        part_no = TaskContext.get().partitionId()
        seen: set[bytes] = set()
        held: list[np.ndarray] = []
        names: list[int] = []

        def blobs():
            keys, owner, count = combined(np.concatenate(held), np.repeat(np.arange(len(held)), [len(h) for h in held]), len(held))
            ids = np.array(names, np.int64)
            rows = list(bucket_rows(keys, owner, ids, buckets))
            if count.any():
                rows.append((-1 - part_no, b"", count[count > 0].astype("<u4").tobytes(), ids[count > 0].astype("<i8").tobytes()))
            cols = [pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3)), pa.nulls(len(rows), pa.binary())]
            held.clear()
            names.clear()
            return pa.RecordBatch.from_arrays(cols, ["bucket", "keys", "owners", "ids", "sigs"])

        total = 0
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                ids = part.column("doc_id").to_pylist()
                sets = shingle_sets(part.column("text"))
                sigs = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                known = np.array([d is not None for d in ids], "u1")
                out = [pa.array([-1 - part_no], pa.int64()), pa.array([known.tobytes()], pa.binary()), pa.array([np.array([len(s) for s in sets], "<u4").tobytes()], pa.binary()), pa.array([np.array([d or 0 for d in ids], "<i8").tobytes()], pa.binary()), pa.array([b"".join(sigs)], pa.binary())]
                yield pa.RecordBatch.from_arrays(out, ["bucket", "keys", "owners", "ids", "sigs"])
                for d, s, g in zip(ids, sets, sigs, strict=True):
                    if d is not None and len(s) and g not in seen:
                        if len(seen) < 200_000:
                            seen.add(g)
                        held.append(first_tokens(s, percent))
                        names.append(d)
                        total += len(held[-1])
                if total >= flush:
                    yield blobs()
                    total = 0
        if held:
            yield blobs()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _BLOBS)


def _filter(scan: DataFrame) -> DataFrame:
    """doc_id, n, sig of all documents (c null), and doc_id, c: shared first tokens in one bucket."""

    def run(t: pa.Table) -> pa.Table:
        release()
        bucket = t["bucket"][0].as_py()
        cols = [t[c].to_pylist() for c in ("keys", "owners", "ids", "sigs")]
        if bucket < 0:
            local = [(x, y) for x, y, g in zip(*cols[1:], strict=True) if g is None]
            cols = list(zip(*(r for r in zip(*cols, strict=True) if r[3] is not None), strict=True))
            known = np.concatenate([np.frombuffer(x, "u1") for x in cols[0]]).astype(bool)
            n = np.concatenate([np.frombuffer(x, "<u4") for x in cols[1]]).astype(np.int64)
            ids = np.concatenate([np.frombuffer(x, "<i8") for x in cols[2]])
            sigs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(n), [None, pa.py_buffer(b"".join(cols[3]))]).cast(pa.binary())
            every = pa.table([pa.array(ids, mask=~known), pa.array(n), sigs, pa.nulls(len(n), pa.int64())], ["doc_id", "n", "sig", "c"])
            if not local:
                return every
            c, ids = (np.concatenate([np.frombuffer(x[k], kind) for x in local]) for k, kind in ((0, "<u4"), (1, "<i8")))
            return pa.concat_tables([every, pa.table([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.binary()), pa.array(c.astype(np.int64))], every.column_names)])
        ids, c = shared_keys(list(zip(*cols[:3], strict=True)))
        return pa.table([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.binary()), pa.array(c.astype(np.int64))], ["doc_id", "n", "sig", "c"])

    return scan.groupBy("bucket").applyInArrow(run, "doc_id long, n long, sig binary, c long")


def _needed_column(n, percent: int):
    """needed() as a column."""
    t = F.ceil(n * percent / 100).cast("long")
    t2 = F.ceil(t * percent / 100).cast("long")
    return F.greatest(F.lit(1).cast("long"), F.least(t2, F.greatest((t * 0.1).cast("long"), F.lit(24).cast("long"))))


SEEDS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)


def _sets_of(docs: DataFrame) -> DataFrame:
    """doc_id, n, tokens and one minimum token for each seed, where the set has the signature sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                sets = shingle_sets(part.column("text"))
                rows = [i for i, (s, g) in enumerate(zip(sets, part.column("sig").to_pylist(), strict=True)) if len(s) and xxhash.xxh3_128_digest(s.tobytes()) == g]
                keys = [pa.array([int(mix64(sets[i] ^ np.uint64(seed)).min().view(np.int64)) for i in rows], pa.int64()) for seed in SEEDS]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(rows, pa.int64())), pa.array([len(sets[i]) for i in rows], pa.int64()), pa.array([sets[i].tobytes() for i in rows], pa.binary()), *keys], ["doc_id", "n", "tokens", "k0", "k1"])

    return docs.select("doc_id", "text", "sig").mapInArrow(run, "doc_id long, n long, tokens binary, k0 long, k1 long")


def _clusters(sets: DataFrame, block: int, percent: int) -> DataFrame:
    """Verified links (leader, member) within blocks of sets that have one minimum token."""

    def run(t: pa.Table) -> pa.Table:
        release()
        t = t.sort_by([("n", "ascending"), ("doc_id", "ascending")])
        ids = t["doc_id"].to_pylist()
        toks = [np.frombuffer(b, np.uint64) for b in t["tokens"].to_pylist()]
        leaders: list[int] = []
        src, dst = [], []
        for i, x in enumerate(toks):
            for j in reversed(leaders):
                if 100 * len(toks[j]) < percent * len(x):
                    break  # leaders stand by size
                if links(toks[j], x, percent):
                    src.append(ids[j])
                    dst.append(ids[i])
                    break
            else:
                leaders.append(i)
        return pa.table([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    keys = sets.select("doc_id", F.explode(F.array(*(F.struct(F.lit(r).alias("round"), F.col(f"k{r}").alias("key")) for r in range(len(SEEDS))))).alias("k")).select("doc_id", "k.round", "k.key")
    blocks = keys.groupBy("round", "key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
    places = cut(keys.join(blocks, ["round", "key"]).select("doc_id", "round", "key", F.pmod(F.xxhash64("doc_id", "round"), F.col("blocks")).cast("int").alias("block")))
    rows = sets.select("doc_id", "n", "tokens").join(small_side(places, 64), "doc_id")
    return rows.groupBy("round", "key", "block").applyInArrow(run, "src long, dst long")


def _shared_tokens(grouped: DataFrame, buckets: int) -> DataFrame:
    """doc_id, c: how many of a set's tokens occur in another group too."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, grp, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "grp", "n"))
            cut_at = [0, *(np.flatnonzero(np.diff(np.cumsum(n) // 1_000_000)) + 1).tolist(), len(ids)]
            for a, b in zip(cut_at[:-1], cut_at[1:], strict=True):
                if a == b:
                    continue
                toks = np.concatenate([np.frombuffer(x, np.uint64) for x in batch.column("tokens").slice(a, b - a).to_pylist()])
                place = np.arange(a, b)
                rows = list(bucket_rows(toks, np.repeat(place, n[a:b]), np.arange(len(ids)), buckets))
                used = [np.frombuffer(r[3], "<i8") for r in rows]
                cols = [pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2)), pa.array([ids[u].astype("<i8").tobytes() for u in used], pa.binary()), pa.array([grp[u].astype("<i8").tobytes() for u in used], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["bucket", "keys", "owners", "ids", "sigs"])

    def count(t: pa.Table) -> pa.Table:
        keys = np.concatenate([unpack_keys(x) for x in t["keys"].to_pylist()])
        ids, grp = ([np.frombuffer(x, "<i8") for x in t[c].to_pylist()] for c in ("ids", "sigs"))
        base = np.cumsum([0, *map(len, ids)])
        owner = np.concatenate([np.frombuffer(x, "<u4").astype(np.int64) + b for x, b in zip(t["owners"].to_pylist(), base, strict=False)])
        ids, grp = np.concatenate(ids), np.concatenate(grp)
        order = np.argsort(keys, kind="stable")
        k, o = keys[order], owner[order]
        start = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        g = grp[o]
        wide = np.minimum.reduceat(g, start) != np.maximum.reduceat(g, start)
        c = np.bincount(o[np.repeat(wide, np.diff(np.append(start, len(k))))], minlength=len(ids))
        return pa.table([pa.array(ids[c > 0]), pa.array(c[c > 0].astype(np.int64))], ["doc_id", "c"])

    packed = grouped.select("doc_id", "n", "grp", "tokens").mapInArrow(pack, _BLOBS)
    return packed.groupBy("bucket").applyInArrow(count, "doc_id long, c long").groupBy("doc_id").agg(F.sum("c").alias("c"))


def _opened(sets: DataFrame, groups: DataFrame, buckets: int, percent: int, block: int = 1024) -> DataFrame:
    """Verified links between different groups: bounds by the token-group matrix, then its groups opened."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy(zero_copy_only=False)
            toks = batch.column("tokens").to_pylist()
            for a in range(0, len(n), 1000):
                rows = pa.array(np.repeat(np.arange(a, min(a + 1000, len(n))), n[a : a + 1000]))
                token = np.concatenate([np.frombuffer(x, np.int64) for x in toks[a : a + 1000]])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("doc_id", "n", "grp", "members")), pa.array(token)], ["doc_id", "n", "grp", "members", "token"])

    def opened(asking: pa.Table, members: pa.Table) -> pa.Table:
        release()
        members = members.sort_by([("n", "ascending"), ("doc_id", "ascending")])
        size = members["n"].to_numpy() if len(members) else np.zeros(0, np.int64)
        ids, toks = members["doc_id"].to_pylist(), [np.frombuffer(x, np.uint64) for x in members["tokens"].to_pylist()]
        grp = members["grp"].to_pylist()
        src, dst = [], []
        parent: dict[int, int] = {}

        def root(g: int) -> int:
            while parent.setdefault(g, g) != g:
                parent[g] = parent[parent[g]]
                g = parent[g]
            return g

        for d, n, g, x in zip(*(asking[c].to_pylist() for c in ("doc_id", "n", "grp", "tokens")), strict=True):
            x = np.frombuffer(x, np.uint64)
            for j in range(*np.searchsorted(size, [-(-percent * n // 100), 100 * n // percent + 1])):
                a, b = root(g), root(grp[j])
                if a != b and links(x, toks[j], percent):  # groups joined already need no further link
                    src.append(d)
                    dst.append(ids[j])
                    parent[max(a, b)] = min(a, b)
        return pa.table([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    t = F.ceil(F.col("n") * percent / 100).cast("long")
    grouped = sets.select("doc_id", "n", "tokens").join(small_side(groups, 32), "doc_id", "left").withColumn("grp", F.coalesce("component", "doc_id")).drop("component")
    alive = cut(grouped.select("doc_id", "n", "grp").join(_shared_tokens(grouped, buckets), "doc_id").filter(F.col("c") >= t).select("doc_id", "grp"))
    alive = cut(alive.join(alive.groupBy("grp").agg(F.count(F.lit(1)).alias("members")), "grp"))
    few = cut(sets.select("doc_id", "n", "tokens").join(small_side(alive, 48), "doc_id"))
    rows = few.select("doc_id", "n", "grp", "members", "tokens").mapInArrow(explode, "doc_id long, n long, grp long, members long, token long")
    # tokens of two groups or more, rarest first: with c such tokens in a set, at most t - 1 lie beyond the first c - t + 1
    wide = rows.groupBy("token").agg(F.min("grp").alias("a"), F.max("grp").alias("b"), F.count(F.lit(1)).alias("f")).filter("a <> b").select("token", "f")
    own = Window.partitionBy("doc_id")
    ranked = rows.join(wide, "token").withColumn("c", F.count(F.lit(1)).over(own)).withColumn("k", F.row_number().over(own.orderBy("f", "token")))
    first = cut(ranked.filter(F.col("k") <= F.col("c") - t + 1).select("doc_id", "n", "grp", "members", "token"))
    # the matrix's groups hold similar sets, linked or not: the components that have one minimum token
    pool = cut(first.groupBy("grp").agg(F.min(F.xxhash64("token")).alias("pool")))
    first = first.join(small_side(pool, 32), "grp")
    held = cut(first.select("doc_id", "n", "grp", "pool").distinct())
    sizes = held.groupBy("pool").agg(F.count(F.lit(1)).alias("held"), F.min("n").alias("least"), F.max("n").alias("most"))
    sizes = cut(sizes)
    matrix = first.select("token", F.col("pool").alias("other_pool")).distinct().join(small_side(sizes.withColumnsRenamed({"pool": "other_pool", "held": "other_held"}), 48), "other_pool")
    # the set of the smaller group asks, the larger group is opened
    asks = (F.col("held") < F.col("other_held")) | ((F.col("held") == F.col("other_held")) & (F.col("pool") <= F.col("other_pool")))
    reach = (100 * F.col("most") >= percent * F.col("n")) & (percent * F.col("least") <= 100 * F.col("n"))
    mine = first.select("doc_id", "n", "pool", "token").join(small_side(sizes.select("pool", "held"), 24), "pool")
    bound = cut(mine.join(matrix, "token").filter(asks & reach).select("doc_id", F.col("other_pool").alias("other_grp")).distinct())
    # both sides of an opened group go to blocks, so that no task holds a whole large group
    asked = bound.groupBy("other_grp").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("ask_blocks"))
    asked = cut(asked.join(sizes.select(F.col("pool").alias("other_grp"), F.ceil(F.col("held") / block).cast("int").alias("blocks")), "other_grp"))
    sets_of = few.select("doc_id", "n", "grp", "tokens")
    member = sets_of.join(small_side(held.select("doc_id", F.col("pool").alias("other_grp")), 24), "doc_id").join(small_side(asked, 24), "other_grp")
    member = member.select("other_grp", "doc_id", "n", "grp", "tokens", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("ask_blocks") - 1)).alias("ask_block"))
    query = sets_of.join(bound.join(small_side(asked, 24), "other_grp"), "doc_id")
    query = query.select("other_grp", "doc_id", "n", "grp", "tokens", F.pmod(F.xxhash64("doc_id"), F.col("ask_blocks")).cast("int").alias("ask_block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    key = ["other_grp", "block", "ask_block"]
    # written first: both sides come from one table, which a cogroup cannot tell apart
    return query.groupBy(*key).cogroup(cut(member).groupBy(*key)).applyInArrow(opened, "src long, dst long")


def join(docs: DataFrame, percent: int = PERCENT, tokens_per_bucket: int = 2_000_000, block: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(8, round(size / 16 / tokens_per_bucket))  # about a first token to 16 bytes of text
    found = cut(_filter(_scan(docs, buckets, percent)))
    every = found.filter("n is not null").select("doc_id", "n", "sig")
    counts = found.filter("c is not null").groupBy("doc_id").agg(F.sum("c").alias("c"))
    known = every.filter("doc_id is not null and n > 0")
    classes = cut(known.join(counts, "doc_id", "left").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("c").alias("c")))
    alive = cut(classes.filter(F.col("c") >= _needed_column(F.col("n"), percent)).select(F.col("rep").alias("doc_id"), "sig"))
    sets = cut(_sets_of(docs.join(small_side(alive, 64), "doc_id")))
    near = cut(_clusters(sets, block, percent).distinct())
    groups = cut(components(near).select(F.col("node").alias("doc_id"), "component"))
    across = _opened(sets, groups, buckets, percent)
    label = components(groups.select(F.col("doc_id").alias("src"), F.col("component").alias("dst")).union(across))
    named = classes.select("sig", "rep").join(label, F.col("rep") == F.col("node"), "left").select("sig", F.coalesce("component", "rep").alias("class_component"))
    out = every.join(named, "sig", "left")
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("class_component")).alias("component_id"))


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    from weftline.llm.common import table

    return join(table(spark, sf_dir, "documents"))
