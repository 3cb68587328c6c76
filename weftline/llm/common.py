"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.lineage import WIDE


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "4m") -> None:
    """Texts go to Python in batches of so many rows and bytes (one longer row is a batch alone): whole
    texts make batches of the usual length large, in the executor's and in the worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a folder of our own only where none is named (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="weftline-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame, options: dict | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage and its shuffles end there.

    A written table rather than checkpoint(): the planner then knows the true size. Sizes of
    checkpointed plans are products of estimates, which loops of joins blow up without bound.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_wide(df: DataFrame) -> DataFrame:
    """cut() for rows of megabytes.

    Parquet looks at the size of a page and of a row group after 100 rows only: with such rows a task's whole
    output is one page, which the writer and its codec hold in memory, and the reader's batch after them.
    """
    return cut(df, WIDE)


def measured(df: DataFrame) -> int:
    """Bytes of the rows of df (a written table): its columns of varying length as they are, eight bytes for others."""
    size = F.lit(0).cast("long")
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            size += F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) + 16
        elif kind in ("array", "map"):
            inner = F.coalesce(F.octet_length(F.to_json(f"`{f.name}`")), F.lit(0))
            size += inner + 16
        else:
            size += 8
    return df.agg(F.coalesce(F.sum(size + 16), F.lit(0))).first()[0]


def small_side(df: DataFrame, bytes_per_row: int | None = None, limit: int = 16 << 20) -> DataFrame:
    """df (a written table) marked for broadcast if its rows take at most limit bytes, else as it is.

    Rows whose columns are all of fixed length may be counted at bytes_per_row; others are measured.
    """
    size = measured(df) if bytes_per_row is None else df.count() * bytes_per_row
    return F.broadcast(df) if size <= limit else df


def picked(rows: DataFrame, wanted: DataFrame, on: list[str], limit: int = 16 << 20) -> DataFrame:
    """Inner join of rows (with texts) with wanted (a written table, few rows a key): wanted is broadcast
    if it is small enough; else, if its keys are, they thin out rows before the shuffle."""
    if measured(wanted) <= limit:
        return rows.join(F.broadcast(wanted), on)
    if wanted.count() * 40 <= limit:
        rows = rows.join(F.broadcast(wanted.select(*on)), on, "left_semi")
    return rows.join(wanted, on)


def marked_rows(rows: DataFrame, marks: DataFrame, on: str, limit: int = 16 << 20) -> DataFrame:
    """rows left joined with marks (a written table, a row a key, columns of its own but for on): rows
    without a mark are not shuffled unless even the keys are too many to broadcast."""
    if measured(marks) <= limit or marks.count() * 40 > limit:
        return rows.join(small_side(marks, limit=limit), on, "left")
    keys = F.broadcast(marks.select(on))
    names = [c for c in marks.columns if c != on]
    plain = rows.join(keys, on, "left_anti").withColumns({c: F.lit(None).cast(marks.schema[c].dataType) for c in names})
    return rows.join(keys, on, "left_semi").join(marks, on).unionByName(plain)


def hot_join(many: DataFrame, one: DataFrame, on: list[str], counts: DataFrame, least: int = 10_000, most_keys: int = 20_000) -> DataFrame:
    """Inner join of many with one (a written table, a row a key), given the rows n of many by key.

    Keys with more than 1 / most_keys of the rows of many (and least rows) are so few that their rows
    of one are broadcast; the others are joined by key, none of which is large any more.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = cut(counts.filter(F.col("n") > max(least, total // most_keys)).select(*on))
    if hot.isEmpty():
        return many.join(one, on)
    few = one.join(F.broadcast(hot), on)
    return many.join(F.broadcast(few), on).unionByName(many.join(F.broadcast(hot), on, "left_anti").join(one, on))


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) of each run of width values."""
    done = 1
    while 2 * done <= width:
        x = best(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return best(x[: len(x) - rest], x[rest:]) if rest else x


def kept_rows(docs: DataFrame, keep) -> DataFrame:
    """The rows of docs, with all columns, for whose texts keep (text column -> booleans) says so; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                yield part.filter(keep(part.column("text")))

    return docs.mapInArrow(run, docs.schema)


def bounded_sample(labels: DataFrame, docs: DataFrame, label: str, per_class: int) -> DataFrame:
    """doc_id, label and whole text of at most per_class documents with each label (0 or 1), by hash of doc_id.

    A doc_id whose labels contradict each other is left out; of rows that share a doc_id the least text
    is taken.
    """
    own = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias(label), F.max(label).alias("other"))
    own = own.filter(F.col(label) == F.col("other")).drop("other")
    known = own.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    picked = None
    for k in (0, 1):  # a limit after an order keeps per_class rows a task; a window would move all of a label to one
        one = known.filter(F.col(label) == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).select("doc_id", label)
        picked = one if picked is None else picked.union(one)
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    return texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", label).agg(F.min("text").alias("text"))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def crc_mod(column, n: int):
    """crc32 of the id written as text, modulo n (null ids: as the text 'null')."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary")) % n


def crc_mod_py(doc_id, n: int) -> int:
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % n


def release() -> None:
    """Give freed memory back to the system: a worker process lives on from task to task, and what its
    allocators hold for arrays long gone would add up with the executor's other workers."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 8 << 20):
    """Cut a batch into runs of rows whose text takes about max_bytes; one long row is a run alone."""
    col = batch.column(column)
    size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    start, n = 0, len(size)
    while start < n:
        base = ends[start] - size[start]
        stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    release()


def whole(texts: pa.Array) -> pa.Array:
    """A copy as large strings, nulls empty, that starts at offset 0: some string kernels go wrong on slices."""
    return pc.fill_null(texts.cast(pa.large_string()), "").take(pa.array(np.arange(len(texts))))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of each text (null: none): flat words and the row each is from."""
    lists = pc.ascii_split_whitespace(whole(texts))
    row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(lists)
    keep = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(keep).as_py():
        mask = keep.to_numpy(zero_copy_only=False)
        flat, row = flat.filter(keep), row[mask]
    return flat, row


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    x ^= x >> np.uint64(33)
    return x


def string_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, the same in every process."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w.as_buffer()) if w.is_valid else 0 for w in words.cast(pa.large_binary())), np.uint64, len(words))


def word_codes(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Dictionary codes of the words, and the distinct words."""
    d = pc.dictionary_encode(flat)
    if isinstance(d, pa.ChunkedArray):
        d = d.combine_chunks()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def hash_words(flat: pa.Array) -> np.ndarray:
    """64-bit hashes of all words; each distinct word is hashed once."""
    codes, distinct = word_codes(flat)
    if not len(codes):
        return np.zeros(0, np.uint64)
    import xxhash

    h = xxhash.xxh3_64_intdigest
    table = np.fromiter(map(h, distinct.cast(pa.large_binary()).to_pylist()), np.uint64, len(distinct))
    return table[codes]
