"""Toxicity: a bidirectional gated recurrent network with attention pooling.

Each word enters as two vectors: one of its own (hashed word table) and one from its characters
(hashed trigrams and beginnings that the word goes on after; the first unit takes their maximum, so
that one telling stem is not lost among them, the others their mean). The network reads windows of ``WINDOW`` words that overlap
by a quarter, attention weighs their positions, and a document's score is that of its highest
window. Trained in numpy; each round trains on every sampled document's highest-scoring window
(first chosen by word log-odds) and on random windows of clean documents. Training runs in 8-byte
numbers, scoring in 4: steps magnify the rounding of sums, whose order differs with the number of
threads, and in 4 bytes the same rows gave other models.

Null and empty texts are one window without words. Words are lower-cased and trimmed of
punctuation. Repeated ids stay one row each; equal texts score alike. Without labels of both kinds
every score is that of an untrained network's bias, 0. Extra columns are not carried. The training
sample is bounded: at most ``per_class`` whole documents a class by hash of doc_id, long and short
alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import gru
from weftline.llm.common import bounded_sample, crc_mod, kept_rows, mix64, release, slices, text_or_empty, word_codes, words_of

WINDOW, STRIDE, BATCH = 48, 36, 4096
WORDS, TRIGRAMS, DIM, HIDDEN, ATTEND = 1 << 14, 1 << 16, 8, 8, 8
STEMS = range(4, 13)  # bytes of a word's beginnings
_TRIM = ".,;:!?\"'()[]{}<>*_-#"


class Lexicon:
    """Distinct words of some texts: word buckets, trigram buckets and whose they are."""

    def __init__(self, distinct: pa.Array, part: int = 1 << 15):
        words = pc.utf8_trim(pc.utf8_lower(distinct.cast(pa.large_string())), _TRIM).cast(pa.large_binary())
        self.n = len(words)
        found = [self._items(words.slice(i, part).to_pylist()) for i in range(0, max(1, self.n), part)]  # in parts: what they take in between is large
        self.bucket, n, self.gram = (np.concatenate([f[k] for f in found]) for k in range(3))
        self.owner = np.repeat(np.arange(self.n, dtype=np.int32), n)
        self._count()

    @staticmethod
    def _items(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word buckets, numbers of trigrams and beginnings, and those one word after another."""
        import xxhash

        h = xxhash.xxh3_64_intdigest
        many = len(words)
        bucket = (np.fromiter(map(h, words), np.uint64, many) % np.uint64(WORDS)).astype(np.int64)
        data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, many)
        owner = np.repeat(np.arange(many), size + 1)[: len(data) - 2]
        gram = ((data[:-2] << 16) + (data[1:-1] << 8) + data[2:]).astype(np.uint64)
        inner = data[1:-1] != 32
        owners, grams = [owner[inner].astype(np.int32)], [gram[inner]]
        first = np.cumsum(size + 1) - size
        stem = np.zeros(many, np.uint64)
        for k in range(max(STEMS)):
            longer = size > k + 1
            stem = np.where(longer, mix64(stem * np.uint64(257) + data[np.minimum(first + k, len(data) - 1)].astype(np.uint64)), stem)
            if k + 1 in STEMS:
                owners.append(np.flatnonzero(longer).astype(np.int32))
                grams.append(stem[longer])
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        gram = (np.concatenate(grams)[order] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TRIGRAMS.bit_length() + 1)
        return bucket, np.bincount(owner, minlength=many), gram.astype(np.int32)

    def _count(self) -> None:
        n = np.bincount(self.owner, minlength=self.n)
        self.ends = np.cumsum(n)
        self.count = np.maximum(n, 1)

    def subset(self, codes: np.ndarray) -> Lexicon:
        """The lexicon of some of the words, in the order given."""
        out = object.__new__(Lexicon)
        out.n, out.bucket = len(codes), self.bucket[codes]
        n = np.diff(self.ends, prepend=0)[codes]
        ends = np.cumsum(n)
        out.owner = np.repeat(np.arange(len(codes), dtype=np.int32), n)
        out.gram = self.gram[np.repeat(self.ends[codes] - ends, n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        out._count()
        return out

    def vectors(self, p: dict[str, np.ndarray], use: np.ndarray | None = None) -> np.ndarray:
        """(2 * DIM, words); use (words): 0 hides a word's own vector, as for words too rare to know."""
        chars = np.zeros((DIM, self.n), p["chars"].dtype)
        chars[0] = self.most(p)[0]
        for k in range(1, DIM):
            chars[k] = np.bincount(self.owner, weights=p["chars"][k][self.gram], minlength=self.n) / self.count
        own = p["words"][:, self.bucket] * p["known"][self.bucket]
        if use is not None:
            own = own * use
        return np.concatenate([own, chars])

    def most(self, p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The greatest first unit among each word's items, and each item's share in it (ties share)."""
        value = p["chars"][0][self.gram]
        best = np.zeros(self.n, value.dtype)
        some = np.diff(self.ends, prepend=0) > 0
        if some.any():
            best[some] = np.maximum.reduceat(value, (self.ends - np.diff(self.ends, prepend=0))[some])
        top = (value == best[self.owner]).astype(value.dtype)
        return best, top / np.maximum(np.bincount(self.owner, weights=top, minlength=self.n), 1)[self.owner].astype(value.dtype)

    def gradients(self, de: np.ndarray, p: dict[str, np.ndarray], use: np.ndarray) -> dict[str, np.ndarray]:
        own, spread = de[:DIM] * (use * p["known"][self.bucket]), (de[DIM:] / self.count)[:, self.owner]
        spread[0] = de[DIM][self.owner] * self.most(p)[1]
        return {
            "words": np.stack([np.bincount(self.bucket, weights=r, minlength=WORDS) for r in own]),
            "chars": np.stack([np.bincount(self.gram, weights=r, minlength=TRIGRAMS) for r in spread]),
        }


def cut_windows(codes: np.ndarray, row: np.ndarray, n_rows: int, blank: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows, WINDOW) of word codes, blank where a window has no word, and each window's row."""
    size = np.bincount(row, minlength=n_rows)
    n = np.maximum(1, -(-(size - (WINDOW - STRIDE)) // STRIDE))
    first = np.concatenate([[0], np.cumsum(size)])[:-1]
    owner = np.repeat(np.arange(n_rows), n)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at = within[:, None] * STRIDE + np.arange(WINDOW)
    live = at < size[owner][:, None]
    flat = np.append(codes, blank)
    return flat[np.where(live, first[owner][:, None] + at, len(codes))], owner


def words_in(lex: Lexicon, windows: np.ndarray) -> tuple[Lexicon, np.ndarray]:
    """The lexicon of the words of some windows, and the windows in its codes."""
    used, idx = np.unique(windows, return_inverse=True)
    if used[-1] != lex.n:
        used = np.append(used, lex.n)
    return lex.subset(used[:-1]), idx.reshape(windows.shape)


class Network:
    def __init__(self, p: dict[str, np.ndarray], trained: bool):
        self.p, self.trained = p, trained

    @staticmethod
    def fresh(seed: int) -> Network:
        rng = np.random.default_rng(seed)
        g = lambda *shape, s=0.3: s * rng.standard_normal(shape)
        p = {"words": g(DIM, WORDS, s=0.1), "known": np.zeros(WORDS), "chars": g(DIM, TRIGRAMS), "xf": g(3 * HIDDEN, 2 * DIM), "xb": g(3 * HIDDEN, 2 * DIM), "bf": g(3 * HIDDEN, s=0), "bb": g(3 * HIDDEN, s=0)}
        p |= {"uf": gru.init(rng, HIDDEN).astype(float), "ub": gru.init(rng, HIDDEN).astype(float), "wa": g(ATTEND, 2 * HIDDEN), "ba": g(ATTEND, s=0), "va": g(ATTEND), "wo": g(2 * HIDDEN), "bo": np.zeros(1)}
        return Network(p, False)

    def tables(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Projected inputs of both directions; the last column, blank, keeps the state as it is."""
        out = []
        for x, b in (("xf", "bf"), ("xb", "bb")):
            t = np.zeros((3 * HIDDEN, e.shape[1] + 1), e.dtype)
            t[:, :-1] = self.p[x] @ e + self.p[b][:, None]
            t[:HIDDEN, -1] = 1e4
            out.append(t)
        return out[0], out[1]

    def logits(self, tf: np.ndarray, tb: np.ndarray, idx: np.ndarray, keep: bool = False):
        """idx (T, B)."""
        p, blank = self.p, tf.shape[1] - 1
        f, b = gru.forward(tf, p["uf"], idx, None, False, keep), gru.forward(tb, p["ub"], idx, None, True, keep)
        h = np.concatenate([f[0] if keep else f, b[0] if keep else b], axis=1)
        s = p["wa"] @ h
        s += p["ba"][:, None]
        np.tanh(s, out=s)
        a = np.einsum("a,tab->tb", p["va"], s, optimize=True)
        live = idx != blank
        a = np.where(live, a, a.dtype.type(-1e9))
        a = np.exp(a - a.max(axis=0))
        a *= live
        a /= np.maximum(a.sum(axis=0), 1e-9)
        c = np.einsum("tb,thb->hb", a, h, optimize=True)
        out = p["wo"] @ c + p["bo"]
        return (out, (h, s, a, c, f[1], b[1])) if keep else out

    def gradients(self, lex: Lexicon, e: np.ndarray, idx: np.ndarray, kept: tuple, d: np.ndarray, use: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        h, s, a, c, kf, kb = kept
        dc = p["wo"][:, None] * d
        da = np.einsum("thb,hb->tb", h, dc, optimize=True)
        de = a * (da - (a * da).sum(axis=0))
        ds = p["va"][:, None] * de[:, None, :] * (1 - s * s)
        dh = a[:, None, :] * dc + p["wa"].T @ ds
        duf, dxf = gru.backward(p["uf"], kf, dh[:, :HIDDEN], None)
        dub, dxb = gru.backward(p["ub"], kb, dh[:, HIDDEN:], None)
        dtf, dtb = (gru.scatter(x, idx, lex.n + 1)[:, :-1] for x in (dxf, dxb))
        g = {"wo": c @ d, "bo": d.sum(keepdims=True), "va": np.einsum("tab,tb->a", s, de, optimize=True), "wa": np.einsum("tab,thb->ah", ds, h, optimize=True), "ba": ds.sum(axis=(0, 2)), "uf": duf, "ub": dub}
        g |= {"xf": dtf @ e.T, "xb": dtb @ e.T, "bf": dtf.sum(axis=1), "bb": dtb.sum(axis=1)}
        return g | lex.gradients(p["xf"].T @ dtf + p["xb"].T @ dtb, p, use)

    def score_windows(self, lex: Lexicon, windows: np.ndarray) -> np.ndarray:
        tf, tb = self.tables(lex.vectors(self.p))
        return np.concatenate([self.logits(tf, tb, np.ascontiguousarray(windows[i : i + BATCH].T)) for i in range(0, len(windows), BATCH)])

    def score(self, texts: pa.Array) -> np.ndarray:
        """Scores (0 to 1) of whole texts."""
        if not self.trained:
            return np.zeros(len(texts))
        codes, row, lex = prepare(texts)
        windows, owner = cut_windows(codes, row, len(texts), lex.n)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owner, self.score_windows(lex, windows))
        return 1 / (1 + np.exp(-best))


def prepare(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Lexicon]:
    flat, row = words_of(texts)
    codes, distinct = word_codes(flat)
    return codes, row, Lexicon(distinct)


def prepare_in_parts(texts: list[str], max_bytes: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, Lexicon]:
    """What prepare() gives, from so many bytes of text at a time: all words of a sample at once are large."""
    codes, rows, distinct, seen, at = [], [], [], 0, 0
    for part in slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"]), "text", max_bytes):
        flat, row = words_of(part.column(0))
        own, words = word_codes(flat)
        codes.append(own + seen)
        rows.append(row + at)
        distinct.append(words)
        seen, at = seen + len(words), at + len(part)
    to, words = word_codes(pa.concat_arrays(distinct))
    return to[np.concatenate(codes)], np.concatenate(rows), Lexicon(words)


def _counted(doc: np.ndarray, item, rows: int = 10_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts of (doc, item) that hold whole documents; doc is in order, item(a, b) gives the items of a part."""
    a = 0
    while a < len(doc):
        b = int(np.searchsorted(doc, doc[min(a + rows, len(doc)) - 1], side="right"))
        own, n = item(a, b)
        yield np.repeat(doc[a:b], n), own
        a = b


def document_odds(y: np.ndarray, doc: np.ndarray, item, n_items: int, prior: float = 3.0) -> np.ndarray:
    """Log-odds of label 1 by items that documents have, drawn to 0 by so many documents of either kind."""
    bad, good = np.zeros(n_items, np.int64), np.zeros(n_items, np.int64)
    for d, i in _counted(doc, item):
        both = np.unique(d * n_items + i)
        d, i = both // n_items, both % n_items
        bad += np.bincount(i[y[d] == 1], minlength=n_items)
        good += np.bincount(i[y[d] == 0], minlength=n_items)
    share = y.mean()
    return np.log((bad + 2 * prior * share) / (good + 2 * prior * (1 - share))) - np.log(share / (1 - share))


def train(texts: list[str], toxic: np.ndarray, rounds: int = 2, steps: int = 60, batch: int = 384, rate: float = 0.02, hide: float = 0.3, decay: float = 1e-2, seed: int = 11) -> Network:
    net = Network.fresh(seed)
    if len(np.unique(toxic)) < 2:
        return net
    rng = np.random.default_rng(seed)
    codes, row, lex = prepare_in_parts(texts)
    windows, owner = cut_windows(codes, row, len(texts), lex.n)
    release()
    y = toxic.astype(np.int64)
    pairs = np.unique(row * (lex.n + 1) + codes)
    doc, word = pairs // (lex.n + 1), pairs % (lex.n + 1)
    net.p["known"] = (np.bincount(np.unique(doc * WORDS + lex.bucket[word]) % WORDS, minlength=WORDS) >= 5).astype(float)
    own = document_odds(y, doc, lambda a, b: (word[a:b], 1), lex.n)

    def grams(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        n = np.diff(lex.ends, prepend=0)[word[a:b]]
        ends = np.cumsum(n)
        return lex.gram[np.repeat(lex.ends[word[a:b]] - ends, n) + np.arange(int(ends[-1]))], n

    by_gram = document_odds(y, doc, grams, TRIGRAMS)
    best_gram = np.full(lex.n, -np.inf)
    np.maximum.at(best_gram, lex.owner, by_gram[lex.gram])
    odds = np.append(np.maximum(own, best_gram), 0.0)
    guess = odds[windows].max(axis=1)
    net.p["words"][0] = net.p["known"] * document_odds(y, doc, lambda a, b: (lex.bucket[word[a:b]], 1), WORDS) / 2
    net.p["chars"][0] = by_gram / 2
    adam = gru.Adam({k: v for k, v in net.p.items() if k != "known"}, rate)
    for r in range(rounds):
        best = np.full(len(texts), -1, np.int64)
        order = np.argsort(guess, kind="stable")
        best[owner[order]] = order
        pos, hard, clean = best[y == 1], best[y == 0], np.flatnonzero(y[owner] == 0)
        hardest = hard[np.argsort(-guess[hard], kind="stable")][: max(1, len(hard) // 5)]
        for step in range(steps):
            adam.rate = rate * (1 - 0.9 * (r * steps + step) / (rounds * steps))
            pick = np.concatenate([rng.choice(pos, batch // 2), rng.choice(hard, batch // 6), rng.choice(hardest, batch // 6), rng.choice(clean, batch // 6)])
            part, idx = words_in(lex, windows[pick])
            idx = np.ascontiguousarray(idx.T)
            want = y[owner[pick]]
            use = (rng.random(part.n) >= hide).astype(float)
            e = part.vectors(net.p, use)
            out, kept = net.logits(*net.tables(e), idx, keep=True)
            d = (1 / (1 + np.exp(-out)) - want) / len(want)
            adam.step(net.p, net.gradients(part, e, idx, kept, d, use))
            net.p["words"] *= 1 - decay
            net.p["chars"] *= 1 - decay
        # in parts with their own words: the driver's memory also holds the JVM
        guess = np.concatenate([net.score_windows(*words_in(lex, windows[i : i + 1024])) for i in range(0, len(windows), 1024)])
    net.p = {k: v.astype(np.float32) for k, v in net.p.items()}
    net.trained = True
    return net


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1200, **how) -> Network:
    """Trained on labels of ids outside the held-out fifth."""
    rows = bounded_sample(labels.filter(crc_mod("doc_id", 5) != 0), docs, "toxic", per_class).collect()
    rows.sort(key=lambda r: r.doc_id)
    texts, toxic = [r.text for r in rows], np.array([r.toxic for r in rows], np.int64)
    del rows
    release()
    net = train(texts, toxic, **how)
    release()
    return net


def keep_clean(docs: DataFrame, net: Network) -> DataFrame:
    """The rows of docs, as they are, that are not predicted toxic."""
    return kept_rows(docs, lambda texts: pa.array(net.score(pc.fill_null(texts, "")) < 0.5))


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(net.score(part.column("text")))], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    from weftline.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
