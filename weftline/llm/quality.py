"""Quality rules: exact counts, and gradient-boosted trees over document statistics.

The trees are trained in numpy on logistic loss with histogram splits and flattened into node
arrays; a batch is scored by walking all rows down all trees at once. More symbols, repeated lines,
repeated words or capitals never raise a score (monotonic constraints).

Null and empty texts have no words and fail the base rule. Repeated ids stay one row each. Without
labels of both kinds the verdict is that of the base rule. Extra columns are not carried. The trees
are fitted on at most ``per_class`` labelled documents a class, those with the smallest hash of
doc_id, long and short alike; every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bounded_sample, mix64, slices, text_or_empty, whole, word_codes, words_of

SHINGLE = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "word_length", "symbols", "dup_lines", "repeats", "capitals", "exclaims", "distinct", "stops", "line_words"]
#: -1: the score may not rise with the feature.
MONOTONE = [0, 0, -1, -1, -1, -1, 0, 0, 0, 0]


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars)] = 1
    return out


_SPACE = b" \t\n\v\f\r"
_CLASSES = {
    "word_chars": np.array([0 if b in _SPACE or 0x80 <= b < 0xC0 else 1 for b in range(256)], np.uint8),
    "n_symbols": _class(b"#*$%&|<>"),
    "capitals": _class(bytes(range(65, 91))),
    "letters": _class(bytes(range(65, 91)) + bytes(range(97, 123))),
    "exclaims": _class(b"!"),
    "stops": _class(b".,;:?"),
}


def _per_text(texts: pa.LargeStringArray) -> dict[str, np.ndarray]:
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    at = offsets - offsets[0]
    out = {}
    for name, table in _CLASSES.items():
        sums = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        out[name] = sums[at[1:]] - sums[at[:-1]]
    return out


def repeated_words(codes: np.ndarray, row: np.ndarray, n_rows: int, size: int = SHINGLE) -> np.ndarray:
    """Words of each row inside windows of size words that occur twice or more in the row."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(n_rows, np.int64)
    inside = row[:n] == row[size - 1 :]
    key = mix64(row[:n])
    for k in range(size):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n].astype(np.uint64))
    ordered = np.sort(key[inside])
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(n_rows, np.int64)
    at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    starts = np.flatnonzero(inside & (twice[at] == key))
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(row[covered], minlength=n_rows)


def statistics(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """COUNTS of each text, and the matrix of FEATURES."""
    texts = whole(column)
    n = len(texts)
    got = _per_text(texts)
    flat, row = words_of(texts)
    codes, distinct = word_codes(flat)
    got["n_words"] = np.bincount(row, minlength=n)
    got["n_repeat_words"] = repeated_words(codes, row, n)
    width = max(1, len(distinct))
    got["distinct"] = np.bincount(np.unique(row * width + codes) // width, minlength=n)
    split = pc.split_pattern(texts, "\n")
    of = pc.list_parent_indices(split).to_numpy(zero_copy_only=False).astype(np.int64)
    line = pc.list_flatten(split)
    mask = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(line)), 0)
    of, line = of[mask.to_numpy(zero_copy_only=False)], line.filter(mask)
    line_code, lines = word_codes(line)
    wide = max(1, len(lines))
    got["n_lines"] = np.bincount(of, minlength=n)
    got["n_dup_lines"] = got["n_lines"] - np.bincount(np.unique(of * wide + line_code) // wide, minlength=n)
    w = np.maximum(got["n_words"], 1)
    x = np.stack(
        [
            np.log1p(got["n_words"]),
            got["word_chars"] / w,
            got["n_symbols"] / w,
            got["n_dup_lines"] / np.maximum(got["n_lines"], 1),
            got["n_repeat_words"] / w,
            got["capitals"] / np.maximum(got["letters"], 1),
            got["exclaims"] / w,
            got["distinct"] / w,
            got["stops"] / w,
            got["n_words"] / np.maximum(got["n_lines"], 1),
        ],
        axis=1,
    )
    return {k: got[k] for k in COUNTS}, x


@dataclass
class Forest:
    """Trees as arrays over all nodes; a leaf points at itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the rows of x."""
        if not len(self.roots):
            return np.full(len(x), 1 / (1 + np.exp(-self.bias)))
        node = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.bias + self.value[node].sum(axis=1))))


def train(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, monotone: list[int] | None = None, ridge: float = 1.0, min_rows: int = 8) -> Forest:
    """Boosted trees of y (0 or 1). Children keep within bounds their parents set, so that every
    constrained feature moves the score one way only."""
    sign = monotone or [0] * x.shape[1]
    rate_y = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    bias = float(np.log(rate_y / (1 - rate_y)))
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []
    if len(np.unique(y)) == 2:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
        f = np.full(len(y), bias)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)

            def leaf(rows, low, high, grad=grad, hess=hess):
                return float(np.clip(-grad[rows].sum() / (hess[rows].sum() + ridge), low, high))

            def grow(rows, level, low, high, f=f, grad=grad, hess=hess):
                at = len(nodes)
                nodes.append([0, np.inf, at, at, leaf(rows, low, high)])
                best = (1e-9, None)
                if level < depth and len(rows) >= 2 * min_rows:
                    total_g, total_h = grad[rows].sum(), hess[rows].sum()
                    for k in range(x.shape[1]):
                        b = binned[rows, k]
                        m = len(edges[k]) + 1
                        g, h, c = (np.cumsum(np.bincount(b, w, m))[:-1] for w in (grad[rows], hess[rows], np.ones(len(rows))))
                        if not len(g):
                            continue
                        gl, gr, hl, hr = g, total_g - g, h + ridge, total_h - h + ridge
                        lv, rv = np.clip(-gl / hl, low, high), np.clip(-gr / hr, low, high)
                        gain = -(gl * lv + 0.5 * hl * lv**2) - (gr * rv + 0.5 * hr * rv**2)
                        v = nodes[at][4]
                        gain += total_g * v + 0.5 * (total_h + ridge) * v**2
                        ok = (c >= min_rows) & (len(rows) - c >= min_rows)
                        if sign[k]:
                            ok &= sign[k] * (rv - lv) >= 0
                        gain = np.where(ok, gain, -np.inf)
                        j = int(gain.argmax())
                        if gain[j] > best[0]:
                            best = (gain[j], (k, j, lv[j], rv[j]))
                if best[1] is None:
                    f[rows] += rate * nodes[at][4]
                    nodes[at][4] *= rate
                    return at
                k, j, lv, rv = best[1]
                go = binned[rows, k] <= j
                mid = (lv + rv) / 2
                bounds = [(low, high), (low, high)]
                if sign[k] < 0:
                    bounds = [(mid, high), (low, mid)]
                elif sign[k] > 0:
                    bounds = [(low, mid), (mid, high)]
                nodes[at][0], nodes[at][1] = k, float(edges[k][j])
                nodes[at][2] = grow(rows[go], level + 1, *bounds[0])
                nodes[at][3] = grow(rows[~go], level + 1, *bounds[1])
                return at

            roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
    cols = list(zip(*nodes, strict=True)) or [[]] * 5
    return Forest(*(np.array(c, t) for c, t in zip(cols, (np.int64, float, np.int64, np.int64, float), strict=True)), np.array(roots, np.int64), depth, bias)


_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", score double"


def measure(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """doc_id, COUNTS, score of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                counts, x = statistics(part.column("text"))
                score = forest.score(x) if forest else np.ones(len(x))
                cols = [part.column("doc_id"), *(pa.array(counts[c].astype(np.int64)) for c in COUNTS), pa.array(score)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *COUNTS, "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, _SCHEMA)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000, **how) -> Forest:
    """Trees of the label quality; the sample is bounded by 2 * per_class documents."""
    sample = bounded_sample(labels, docs, "quality", per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                x = statistics(part.column("text"))[1]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list(x), pa.list_(pa.float64())), part.column("quality")], ["doc_id", "features", "quality"])

    measured = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("quality").cast("int").alias("quality"))
    rows = measured.mapInArrow(run, "doc_id long, features array<double>, quality int").collect()
    rows.sort(key=lambda r: r.doc_id)
    x = np.array([r.features for r in rows]).reshape(len(rows), len(FEATURES))
    return train(x, np.array([float(r.quality) for r in rows]), monotone=MONOTONE, **how)


def judge(docs: DataFrame, forest: Forest | None) -> DataFrame:
    out = measure(docs, forest)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= 0.5))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    from weftline.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = fit(docs, table(spark, sf_dir, "labels"))
    return judge(docs, forest).select("doc_id", *COUNTS, "base_failed", "kept", "score")
