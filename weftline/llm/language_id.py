"""Language identification by a bidirectional gated recurrent network over bytes.

Trained in numpy by backpropagation through time on windows of labelled texts. For scoring, every
whole text is cut into windows of ``WINDOW`` bytes; the network labels every byte, and a document's
probabilities are the means over its bytes. A text that is null or has no letter gets ``und`` with
score 1.0. Without any labelled text every document gets ``und`` with score 0.0. Equal texts get
equal results; ties go to the first language in alphabetical order. Extra columns are not carried.

The training sample is bounded: at most ``per_lang`` documents of each language, those with the
smallest hash of doc_id, and of each at most ``per_text`` windows, drawn over its whole text. Letters
are the characters of Unicode's category L. Every document is scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import gru
from weftline.llm.common import crc_mod, kept_rows, release, slices, text_or_empty

WINDOW = 64
BATCH = 4096
LETTER = regex.compile(r"\p{L}")


def windows(data: np.ndarray, length: int) -> np.ndarray:
    """(windows, length) of one text's bytes; the last is filled up with 0."""
    out = np.zeros((-(-len(data) // length), length), np.uint8)
    out.reshape(-1)[: len(data)] = data
    return out


class ByteTagger:
    """Languages and weights; picklable."""

    def __init__(self, langs: list[str], params: dict[str, np.ndarray]):
        self.langs, self.p = langs, params

    def log_odds(self, idx: np.ndarray) -> np.ndarray:
        """Class scores (T, classes, B) of every position of idx (T, B)."""
        p = self.p
        out = p["of"] @ gru.forward(p["tf"], p["uf"], idx, None, False)
        out += p["ob"] @ gru.forward(p["tb"], p["ub"], idx, None, True)
        out += p["bias"][:, None]
        return out

    def position_probabilities(self, idx: np.ndarray) -> np.ndarray:
        s = self.log_odds(idx)
        s -= s.max(axis=1, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(axis=1, keepdims=True)
        return s

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """(texts, classes): mean probabilities over the bytes of each text; empty texts get 0."""
        total = np.zeros((len(texts), len(self.langs)))
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        n = -(-size // WINDOW)
        if not n.sum():
            return total
        owner = np.repeat(np.arange(len(texts)), n)
        data = np.zeros(int(n.sum()) * WINDOW, np.uint8)
        at = np.concatenate([[0], np.cumsum(n)]) * WINDOW
        for i, t in enumerate(texts):
            data[at[i] : at[i] + len(t)] = np.frombuffer(t, np.uint8)
        rows = data.reshape(-1, WINDOW)
        used = np.full(len(rows), WINDOW)
        last = np.cumsum(n)[n > 0] - 1
        used[last] = size[n > 0] - (n[n > 0] - 1) * WINDOW
        for a in range(0, len(rows), BATCH):
            part = np.ascontiguousarray(rows[a : a + BATCH].T)
            prob = self.position_probabilities(part)
            prob *= (np.arange(WINDOW)[:, None] < used[a : a + BATCH])[:, None, :]
            sums = prob.sum(axis=0, dtype=np.float64)
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(owner[a : a + BATCH], weights=sums[k], minlength=len(texts))
        return total / np.maximum(size, 1)[:, None]


def train(samples: list[tuple[bytes, str]], hidden: int = 8, steps: int = 220, batch: int = 512, rate: float = 0.02, seed: int = 7) -> ByteTagger:
    langs = sorted({lang for _, lang in samples})
    rng = np.random.default_rng(seed)
    k = len(langs)
    cut, label = [], []
    for text, lang in samples:
        if text:
            w = windows(np.frombuffer(text, np.uint8), WINDOW)
            w = w[: max(1, len(text) // WINDOW)]
            cut.append(w)
            label.append(np.full(len(w), langs.index(lang)))
    p = {"tf": 0.3 * rng.standard_normal((3 * hidden, 256)), "tb": 0.3 * rng.standard_normal((3 * hidden, 256)), "of": 0.3 * rng.standard_normal((k, hidden)), "ob": 0.3 * rng.standard_normal((k, hidden)), "bias": np.zeros(k)}
    p = {n: v.astype(np.float32) for n, v in p.items()} | {"uf": gru.init(rng, hidden), "ub": gru.init(rng, hidden)}
    model = ByteTagger(langs, p)
    if not cut or k < 2:
        return model
    rows, y = np.concatenate(cut), np.concatenate(label)
    by_class = [np.flatnonzero(y == c) for c in range(k)]
    adam = gru.Adam(p, rate)
    for step in range(steps):
        adam.rate = rate * (1 - 0.9 * step / steps)
        pick = np.concatenate([rng.choice(c, batch // k + 1) for c in by_class if len(c)])
        idx, want = np.ascontiguousarray(rows[pick].T), y[pick]
        hf, kf = gru.forward(p["tf"], p["uf"], idx, None, False, keep=True)
        hb, kb = gru.forward(p["tb"], p["ub"], idx, None, True, keep=True)
        s = p["of"] @ hf + p["ob"] @ hb + p["bias"][:, None]
        s = np.exp(s - s.max(axis=1, keepdims=True))
        s /= s.sum(axis=1, keepdims=True)
        s[:, want, np.arange(len(want))] -= 1
        s *= (idx != 0)[:, None, :] / np.float32(max(1, (idx != 0).sum()))
        duf, dxf = gru.backward(p["uf"], kf, p["of"].T @ s, None)
        dub, dxb = gru.backward(p["ub"], kb, p["ob"].T @ s, None)
        g = {"uf": duf, "ub": dub, "tf": gru.scatter(dxf, idx, 256), "tb": gru.scatter(dxb, idx, 256), "of": np.einsum("tkb,thb->kh", s, hf, optimize=True), "ob": np.einsum("tkb,thb->kh", s, hb, optimize=True), "bias": s.sum(axis=(0, 2))}
        adam.step(p, g)
    return model


def drawn(text: bytes, per_text: int, seed: int) -> bytes:
    """At most per_text windows of a text, drawn over the whole of it; shorter texts as they are."""
    n = len(text) // WINDOW
    if n <= per_text:
        return text
    at = np.sort(np.random.default_rng(seed).choice(n, per_text, replace=False))
    return np.frombuffer(text, np.uint8)[: n * WINDOW].reshape(n, WINDOW)[at].tobytes()


def training_sample(docs: DataFrame, per_lang: int, per_text: int) -> list[tuple[bytes, str]]:
    """At most per_lang documents of each language and per_text windows of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [drawn(t.encode(), per_text, zlib.crc32(t.encode())) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(data, pa.binary())], ["lang", "data"])

    rows = docs.filter(F.col("lang").isNotNull() & (crc_mod("doc_id", 4) != 2) & F.col("text").isNotNull())
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "t")
    hashes = rows.select("doc_id", "lang", F.xxhash64(F.col("doc_id")).alias("h"), F.xxhash64("text").alias("t"))
    ids = hashes.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= per_lang).select("doc_id", "lang", "t")
    # (doc_id, lang, text) once each: repeated rows do not make the sample larger
    texts = rows.withColumn("t", F.xxhash64("text")).join(F.broadcast(ids.distinct()), ["doc_id", "lang", "t"], "left_semi")
    picked = texts.select("lang", "text").mapInArrow(run, "lang string, data binary").groupBy("lang", "data").count()
    return sorted((bytes(r.data), r.lang) for r in picked.collect())


def fit(docs: DataFrame, per_lang: int = 200, per_text: int = 24, **how) -> ByteTagger:
    model = train(training_sample(docs, per_lang, per_text), **how)
    release()
    return model


def keep_known(docs: DataFrame, model: ByteTagger, least: float) -> DataFrame:
    """The rows of docs, as they are, that have a letter and whose language is known with a score of least or more."""

    def known(texts: pa.Array) -> pa.Array:
        lang, score = judged(model, texts)
        return pa.array([p != "und" and s >= least for p, s in zip(lang, score, strict=True)], pa.bool_())

    return kept_rows(docs, known)


def judged(model: ByteTagger, column: pa.Array) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    texts = [t or "" for t in column.to_pylist()]
    lang, score = ["und"] * len(texts), [1.0] * len(texts)
    rows = [i for i, t in enumerate(texts) if LETTER.search(t)]
    if not model.langs:
        for i in rows:
            score[i] = 0.0
    elif rows:
        prob = model.pooled([texts[i].encode() for i in rows])
        for i, q in zip(rows, prob, strict=True):
            lang[i], score[i] = model.langs[int(q.argmax())], float(min(1.0, q.max()))
    return lang, score


def identify(docs: DataFrame, model: ByteTagger) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                lang, score = judged(model, part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    from weftline.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, fit(docs))
