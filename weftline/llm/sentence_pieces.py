"""Encoding and decoding with a sentencepiece model on the tokenizers library.

The model protobuf is parsed here (wire format only, no generated code): pieces with scores and
kinds, the model type, byte fallback, and the normaliser. From it a ``Tokenizer`` is built: unigram
scores as they are, or for a BPE model the merges that its scores imply; the normaliser's character
map, white-space rules and the metaspace marker; byte fallback; and the matching decoder. Where no
piece has the marker after another character, text is split before each run of markers, which no
piece could cross, so the library can cache words.

Batches are encoded by the library's threads. Each worker process checks the first batch it meets,
and one text in sixteen (by checksum) of every batch, against the sentencepiece library and fails on
any difference. The strings of control and unknown pieces are ordinary text. Models with
user-defined pieces, and unigram models with byte fallback, are refused: the library splits texts
around their strings otherwise.

Nulls count as empty texts: no pieces, decoded to the empty text. Extra columns are not carried.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import slices, text_or_empty

MARK = "▁"
# Fixed values of the model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    strip_extra: bool = True
    escape: bool = True


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """(number, value) of a protobuf message's fields."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire == 1:
            value, at = data[at : at + 8], at + 8
        elif wire == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        elif wire == 5:
            value, at = struct.unpack("<f", data[at : at + 4])[0], at + 4
        else:
            raise ValueError(f"wire type {wire}")
        yield key >> 3, value


def parse_model(data: bytes) -> Model:
    m = Model()
    for number, value in fields(data):
        if number == 1:
            x = dict(fields(value))
            m.pieces.append((x.get(1, b"").decode(), float(x.get(2, 0.0)), int(x.get(3, NORMAL))))
        elif number == 2:
            x = dict(fields(value))
            m.kind, m.byte_fallback = int(x.get(3, UNIGRAM)), bool(x.get(35, 0))
        elif number == 3:
            x = dict(fields(value))
            m.charsmap = x.get(2, b"")
            m.dummy_prefix, m.strip_extra, m.escape = (bool(x.get(k, 1)) for k in (3, 4, 5))
    return m


def merges_of(m: Model) -> list[tuple[str, str]]:
    """Pairs that join to a piece, best score first; a pair's order is that of the piece it makes."""
    rank = {p: i for i, (p, _, kind) in enumerate(m.pieces) if kind in (NORMAL, USER)}
    out = []
    for piece, i in rank.items():
        for k in range(1, len(piece)):
            a, b = piece[:k], piece[k:]
            if a in rank and b in rank:
                out.append((-m.pieces[i][1], i, rank[a], rank[b], a, b))
    out.sort()
    return [x[4:] for x in out]


def build(m: Model):
    """The tokenizers.Tokenizer that encodes and decodes as the model does."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if any(kind == USER for _, _, kind in m.pieces) or (m.kind == UNIGRAM and m.byte_fallback):
        raise ValueError("user-defined pieces and byte fallback of unigram models are not supported")
    unk = next(i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN)
    low = min((s for _, s, kind in m.pieces if kind == NORMAL), default=0.0)
    if m.kind == UNIGRAM:
        tok = Tokenizer(models.Unigram([(p, s) if kind == NORMAL else (f"\0{p}", low) for p, s, kind in m.pieces], unk, False))
    elif m.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        tok = Tokenizer(models.BPE(vocab, merges_of(m), unk_token=m.pieces[unk][0], fuse_unk=True, byte_fallback=m.byte_fallback))
    else:
        raise ValueError(f"model type {m.kind}")
    steps = []
    if m.charsmap:
        steps.append(normalizers.Precompiled(m.charsmap))
    if m.strip_extra:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if m.escape:
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        tok.normalizer = normalizers.Sequence(steps)
    if m.escape and not any(MARK in p.lstrip(MARK) for p, _, kind in m.pieces if kind in (NORMAL, USER)):
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    back = [decoders.Replace(MARK, " "), *([decoders.ByteFallback()] if m.byte_fallback else []), decoders.Fuse()]
    if m.dummy_prefix:
        back.append(decoders.Strip(" ", 1, 0))
    tok.decoder = decoders.Sequence(back)
    return tok


def load(path: str):
    with open(path, "rb") as f:
        return build(parse_model(f.read()))


_LOADED: dict[str, object] = {}
_CHECKS: dict[str, object] = {}


def verify_parity(tok, path: str, texts: list[str]) -> None:
    """Raises if the sentencepiece library encodes or decodes any of texts otherwise."""
    import sentencepiece

    if not texts:
        return
    if path not in _CHECKS:
        _CHECKS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    sp = _CHECKS[path]
    got = [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    want = sp.encode(texts, num_threads=1)
    for t, a, b in zip(texts, got, want, strict=True):
        if a != b:
            raise ValueError(f"encoding differs from the library's for {t[:80]!r}")
    for t, a, b in zip(texts, tok.decode_batch(want, skip_special_tokens=False), sp.decode(want), strict=True):
        if a != b:
            raise ValueError(f"decoding differs from the library's for {t[:80]!r}")




def _worker_tokenizer(path: str, threads: int, texts: list[str]):
    if path not in _LOADED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        tok = load(path)
        verify_parity(tok, path, texts)
        _LOADED[path] = tok
    else:
        verify_parity(_LOADED[path], path, [t for t in texts if zlib.crc32(t.encode()) % 16 == 0])
    return _LOADED[path]


def encode(docs: DataFrame, model_path: str, threads: int = 2) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32 bit), decoded (text that the ids give back)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                texts = part.column("text").to_pylist()
                tok = _worker_tokenizer(model_path, threads, texts)
                ids = [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
                back = tok.decode_batch(ids, skip_special_tokens=False)
                packed = pa.array([np.asarray(x, "<u4").tobytes() for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), packed, pa.array(back, pa.string())], ["doc_id", "text", "ids", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, text string, ids binary, decoded string")


def op8_sentence_pieces(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from weftline.llm.common import table

    out = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        (F.octet_length("ids") / 4).cast("long").alias("n_pieces"),
        F.crc32("ids").alias("ids_crc32"),
        F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"),
        (F.col("decoded") == F.col("text")).alias("round_trip"),
    )
