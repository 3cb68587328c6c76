"""Phrase collocation mining per language: sketch bounds, guarded automata, exact sums, thresholds.

1. Texts are normalised (A-Z lower-cased, words between single spaces, pieces between `` \\n ``) and
   written as shards of one language and about ``shard_bytes`` each.
2. Sketch: every shard sends the cells of its distinct phrases of 1 to ``max_words`` words, with
   counts, to the owners of the cells' blocks (delta-coded, about two bytes a phrase). The number
   of blocks follows the input's size, so the mean load of a cell, and with it the share of false
   candidates, stays alike at any size. An owner adds the shards up; a cell's sum is an upper bound
   for every phrase in it. It answers each shard with those of the shard's cells that reach ``least``.
3. The phrases of a shard in such cells are the shard's candidates: every phrase with ``least``
   occurrences is a candidate wherever it occurs. They are compiled, each word as a pair of characters
   that guard its bounds, into an Aho-Corasick automaton, which scans the shard so written: all
   overlapping occurrences are matched, and none within words or across pieces. An automaton takes
   ``MOST_PATTERNS``; a shard with more candidates is cut into parts.
4. The shards' counts are summed (pre-aggregated by shard), and only then compared with ``least``:
   what the sketch let through by chance goes here. Scores, containment and ranks are joins and
   windows over the candidates; numbers are decimals where a product may pass 64 bits.

Shards bound the memory of every task, whatever the language's share of the input; a language is
never gathered in one task. Ranks are taken in three levels of windows.

Null texts are empty; null languages are ``und``. Empty tables give no rows. Ids are not used, so
repeated ids and rows simply count. Extra columns are not read. Ties end in byte order of phrases.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import cut, cut_wide, hot_join, mix64, release, slices, string_hashes, text_or_empty

UPPER = bytes(range(65, 91))
DELIMITERS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(UPPER + b"\t" + DELIMITERS, UPPER.lower() + b" " + b"\n" * len(DELIMITERS))
CELLS = 24  # bits of a cell within its block
BLOCK_LOAD = 4 << 20  # expected phrases a block: a quarter of its cells


def normalise(data: bytes) -> bytes:
    """`` w w \\n w w \\n ``: words between single spaces, a line feed as a word where a piece ends."""
    out = b" " + data.translate(_TABLE).replace(b"\n", b" \n ") + b" \n "
    while b"  " in out:
        out = out.replace(b"  ", b" ")
    return out


def shards(docs: DataFrame, shard_bytes: int = 8 << 20) -> DataFrame:
    """shard, lang, n_bytes, text of all docs (text, lang), written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, k, held = TaskContext.get().partitionId() << 32, 0, {}
        size = 0

        def take(lang):
            nonlocal k, size
            parts = held.pop(lang)
            data = b"\n".join(parts)  # each begins and ends with a space
            size -= sum(map(len, parts))
            k += 1
            return pa.RecordBatch.from_arrays([pa.array([base + k], pa.int64()), pa.array([lang], pa.string()), pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())], ["shard", "lang", "n_bytes", "text"])

        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    data = normalise(text)
                    held.setdefault(lang, []).append(data)
                    size += len(data)
                    while size >= shard_bytes:
                        yield take(max(held, key=lambda x: sum(map(len, held[x]))))
        while held:
            yield take(next(iter(held)))
        release()

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_or_empty().alias("text"))
    return cut_wide(rows.mapInArrow(run, "shard long, lang string, n_bytes long, text binary"))


class Tokens:
    """Word starts, and hashes of all phrases, of a shard."""

    def __init__(self, lang: str, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        self.at = (np.flatnonzero(raw == 32) + 1).astype(np.int64)  # word i is data[at[i] : at[i + 1] - 1]
        words = pa.Array.from_buffers(pa.large_binary(), len(self.at) - 1, [None, pa.py_buffer(self.at), pa.py_buffer(data)])
        coded = pc.dictionary_encode(words)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        stop = pc.index(coded.dictionary, pa.scalar(b"\n ", pa.large_binary())).as_py()
        salt = string_hashes(pa.array([lang]))[0]
        self.hashes = mix64(string_hashes(coded.dictionary) ^ salt)[codes]
        self.codes, self.stop = codes, codes == stop

    def phrases(self, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, places, hashes) of all phrases that lie within a piece."""
        g, ok = self.hashes, ~self.stop
        for k in range(1, most + 1):
            if k > 1:
                g = mix64(g[:-1] * np.uint64(0x9E3779B97F4A7C15) + self.hashes[k - 1 :])
                ok = ok[:-1] & ~self.stop[k - 1 :]
            places = np.flatnonzero(ok)
            yield k, places, g[places]


def keys_of(hashes: np.ndarray, blocks: int) -> np.ndarray:
    """Cell numbers; the upper bits are the block."""
    return (hashes >> np.uint64(8)) % np.uint64(blocks << CELLS)


def pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit values by bytes of equal weight, compressed."""
    return pa.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _pack_sorted(cells: np.ndarray) -> bytes:
    return pack(np.diff(cells, prepend=0))


def _unpack_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(data, n), dtype=np.int64)


SENT = "block long, shard long, n long, cells binary, counts binary"


def sketch(parts: DataFrame, blocks: int, most: int) -> DataFrame:
    """What every shard adds to each block of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, lang, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "lang", "text")), strict=True):
                keys = np.concatenate([keys_of(g, blocks) for _, _, g in Tokens(lang, data).phrases(most)])
                if not len(keys):
                    continue
                keys, counts = np.unique(keys, return_counts=True)
                found, starts = np.unique(keys >> np.uint64(CELLS), return_index=True)
                cells = (keys & np.uint64((1 << CELLS) - 1)).astype(np.int64)
                ends = np.append(starts[1:], len(keys))
                counts = np.minimum(counts, 0xFFFFFFFF)
                columns = [[int(b) for b in found], [shard] * len(found), [int(b - a) for a, b in zip(starts, ends, strict=True)]]
                packed = [[_pack_sorted(cells[a:b]) for a, b in zip(starts, ends, strict=True)], [pack(counts[a:b]) for a, b in zip(starts, ends, strict=True)]]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns + packed, kinds, strict=True)], ["block", "shard", "n", "cells", "counts"])
                release()

    return parts.select("shard", "lang", "text").mapInArrow(run, SENT)


def answers(sent: DataFrame, least: int) -> DataFrame:
    """Per shard and block: those of its cells whose sum over all shards is at least least."""

    def add(t: pa.Table) -> pa.Table:
        sums = np.zeros(1 << CELLS, np.uint64)
        rows = [(s, n, _unpack_sorted(c, n), k) for s, n, c, k in zip(*(t[c].to_pylist() for c in ("shard", "n", "cells", "counts")), strict=True)]
        for _, n, cells, counts in rows:
            sums[cells] += unpack(counts, n)  # a shard's cells are distinct
        block, out = t["block"][0].as_py(), []
        for shard, _, cells, _ in rows:
            hot = cells[sums[cells] >= least]
            if len(hot):
                out.append((shard, block, len(hot), _pack_sorted(hot)))
        release()
        columns = zip(*out, strict=True) if out else [()] * 4
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["shard", "block", "n", "cells"])

    return sent.groupBy("block").applyInArrow(add, "shard long, block long, n long, cells binary")


def automaton(patterns: Iterator[str]):
    import ahocorasick

    a = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, p in enumerate(patterns):
        a.add_word(p, i)
    a.make_automaton()
    return a


#: Patterns of one automaton, unless a single line has more: some 60 MB, however many phrases are candidates.
MOST_PATTERNS = 200_000


def count_shard(lang: str, data: bytes, hot: np.ndarray, blocks: int, most: int, limit: int = MOST_PATTERNS) -> Iterator[tuple[list[str], list[int], list[int]]]:
    """Phrases of the shard in hot cells (sorted keys), their words, and all their occurrences; the phrase '' counts words.

    The more the input, the more of a shard's phrases are candidates: a text with more than limit of them is
    halved at the end of a piece, and each half is counted with an automaton of its own phrases.
    """
    tokens = Tokens(lang, data)
    found = []
    for k, places, g in tokens.phrases(most):
        keys = keys_of(g, blocks)
        near = np.minimum(np.searchsorted(hot, keys), max(len(hot) - 1, 0))
        mine = hot[near] == keys if len(hot) else np.zeros(len(keys), bool)
        found.append((k, places[mine][np.unique(g[mine], return_index=True)[1]]))
    if sum(len(p) for _, p in found) > limit:
        ends = np.flatnonzero(tokens.stop[:-1])  # a line feed is a word; the text after it begins with its space
        if len(ends):
            middle = int(tokens.at[ends[np.argmin(np.abs(tokens.at[ends] - len(data) // 2))] + 1])
            del tokens, found
            yield from count_shard(lang, data[:middle], hot, blocks, most, limit)
            yield from count_shard(lang, data[middle - 1 :], hot, blocks, most, limit)
            return
    used = [tokens.codes[starts + i] for k, starts in found for i in range(k)]
    used = np.unique(np.concatenate(used)) if used else np.zeros(0, np.int64)
    # a word is two characters, of which the second one's never begin a word: matches lie at words, as guarded
    pair = np.empty((len(tokens.codes), 2), "<u4")
    number = np.searchsorted(used, tokens.codes)
    known = used[np.minimum(number, max(len(used) - 1, 0))] == tokens.codes if len(used) else np.zeros(len(number), bool)
    pair[:, 0], pair[:, 1] = np.where(known, 0x10000 + (number >> 8), 1), np.where(known, 0x4000 + (number & 255), 2)
    coded = pair.tobytes().decode("utf-32-le")
    counts = Counter(map(itemgetter(1), automaton(coded[2 * s : 2 * (s + k)] for k, starts in found for s in starts.tolist()).iter(coded))) if len(used) else {}
    at, n = tokens.at, 0
    yield [""], [0], [int(np.count_nonzero(~tokens.stop))]
    for k, starts in found:
        for a in range(0, len(starts), 50_000):
            some = starts[a : a + 50_000]
            phrases = [data[x : y - 1].decode() for x, y in zip(at[some].tolist(), at[some + k].tolist(), strict=True)]
            yield phrases, [k] * len(some), [counts[n + i] for i in range(len(some))]
            n += len(some)


def phrase_counts(docs: DataFrame, least: int = 30, most: int = 4, shard_bytes: int = 8 << 20) -> DataFrame:
    """lang, phrase, k (its words), a (its occurrences) of all phrases of up to most words with a >= least,
    and with the phrase '' and k 0 the words of each lang; written."""
    parts = shards(docs, shard_bytes)
    total = parts.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    blocks = max(1, -(-total * most // (6 * BLOCK_LOAD)))  # words take about six bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, data, hot in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "hot")), strict=True):
                cells = [(x["block"] << CELLS) + _unpack_sorted(x["cells"], x["n"]) for x in hot or ()]
                keys = np.sort(np.concatenate(cells)).astype(np.uint64) if cells else np.zeros(0, np.uint64)
                for phrases, sizes, counts in count_shard(lang, data, keys, blocks, most):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.string()), pa.array(sizes, pa.int32()), pa.array(counts, pa.int64())], ["lang", "phrase", "k", "a"])
                release()

    hot = answers(sketch(parts, blocks, most), least).groupBy("shard").agg(F.collect_list(F.struct("block", "n", "cells")).alias("hot"))  # at most a shard's own cells
    joined = parts.select("shard", "lang", "text").join(cut_wide(hot).hint("shuffle_hash"), "shard", "left")
    counted = joined.select("lang", "text", "hot").mapInArrow(run, "lang string, phrase string, k int, a long")
    return cut(counted.groupBy("lang", "phrase", "k").agg(F.sum("a").alias("a")).filter((F.col("a") >= least) | (F.col("k") == 0)))


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r, score of the candidates of phrase_counts: the cut with the lowest score, ties to the first."""
    words = F.split("phrase", " ")
    cuts = counts.filter("k >= 2").select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumn("first", F.concat_ws(" ", F.slice(words, 1, F.col("cut")))).withColumn("rest", F.concat_ws(" ", F.slice(words, F.col("cut") + 1, F.col("k") - F.col("cut"))))
    for side, name in (("first", "l"), ("rest", "r")):
        other = counts.filter("k >= 1").select("lang", F.col("phrase").alias(side), F.col("a").alias(name))
        cuts = cut(hot_join(cuts, other, ["lang", side], cuts.groupBy("lang", side).agg(F.count(F.lit(1)).alias("n"))))
    wide = "decimal(20,0)"
    score = F.expr(f"(cast(a as {wide}) * cast(2000000 as {wide})) div (cast(l as {wide}) + cast(r as {wide}))")
    best = F.min(F.struct(score.cast("long").alias("score"), "cut", "l", "r")).alias("best")
    return cuts.groupBy("lang", "phrase", "k", "a").agg(best).select("lang", "phrase", "k", "a", "best.l", "best.r", "best.score")


def uncontained(found: DataFrame, share: int = 80) -> DataFrame:
    """Without phrases that lie within a longer one of found which has share percent of their occurrences."""
    inner = F.explode(F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))"))
    longer = found.filter("k >= 3").select("lang", F.col("a").alias("longer"), inner.alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    wide = "decimal(20,0)"
    return found.join(longer, ["lang", "phrase"], "left").filter(F.expr(f"longer is null or cast(100 as {wide}) * cast(longer as {wide}) < cast({share} as {wide}) * cast(a as {wide})")).drop("longer")


def top_per_lang(found: DataFrame, top: int, levels: tuple[int, ...] = (256, 16, 1)) -> DataFrame:
    """The first top rows of each lang with their rank; each level keeps top rows of every salt, so that
    no window holds more than a small part of a lang."""
    for salts in levels:
        salted = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
        order = Window.partitionBy("lang", "salt").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
        found = salted.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top).drop("salt")
    return found


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, most: int = 4, share: int = 80, shard_bytes: int = 8 << 20) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of 2 to most words of each lang."""
    counts = phrase_counts(docs, least, most, shard_bytes)
    best = top_per_lang(uncontained(cut(scored(counts)), share), top)
    n = counts.filter("k = 0").select("lang", F.col("a").alias("n"))
    return best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    from weftline.llm.common import table

    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM words, (VALUES (1), (2), (3), (4)) AS sizes(k)),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM grams GROUP BY 1, 2, 3),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND a >= 30),
cuts AS (SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS c FROM cand),
scores AS (
  SELECT x.lang, x.k, x.phrase, x.a, c, l.a AS l, r.a AS r, CAST(CAST(2000000 AS HUGEINT) * x.a // (l.a + r.a) AS BIGINT) AS score
  FROM cuts x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(w[1:c], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(w[c + 1:], ' ')),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
sizes AS (SELECT lang, phrase, k, a, w, unnest(range(2, k)) AS m FROM cand),
inner_ AS (SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS i FROM sizes)),
longer AS (SELECT lang, phrase, max(a) AS longer FROM inner_ GROUP BY 1, 2),
kept AS (SELECT b.* FROM best b LEFT JOIN longer o USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
