"""Token counts of whole texts; huge documents by overlap resynchronisation.

A text of at most ``chunk_chars`` characters is encoded at once. A longer one is cut into chunks
that overlap; each is encoded with offsets, and neighbours are spliced at a pre-token boundary that
both encodings share.

Why such a splice is exact: the pre-tokeniser scans left to right and looks ahead only, so from a
boundary both scans share they go on alike; merges never cross a pre-token. The left scan is true
up to its cut end except near it, where a run may have been cut short. So a boundary counts as
stable only if the pre-token after it also ends at one place in both encodings, more than
``MARGIN`` characters (longer than any special string) before the left chunk's end. Where no such
boundary exists (one word longer than the overlap), the overlap doubles until there is one or the
chunk reaches the end of the text.

Nulls and empty texts have 0 bytes and 0 tokens. Repeated ids stay one row each. Other columns of
the input are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import slices, text_or_empty

MARGIN = 64


def _boundaries(enc, base: int) -> dict[int, tuple[int, int]]:
    """Start of each pre-token or special token -> (its end, tokens before it)."""
    out: dict[int, tuple[int, int]] = {}
    last, start, at = object(), None, 0
    words, offsets = enc.word_ids, enc.offsets
    ends = 0
    for i, (w, (a, b)) in enumerate(zip(words, offsets, strict=True)):
        if w is None or w != last:
            if start is not None:
                out[start] = (ends, at)
            start, at, last = base + a, i, w
        ends = base + b
    if start is not None:
        out[start] = (ends, at)
    return out


def count_long(tokenizer, text: str, chunk: int = 32_768, overlap: int = 1_024) -> int:
    """Tokens of text, as the tokenizer counts them over the whole of it."""
    n, total = len(text), 0
    start, stop = 0, min(len(text), chunk)
    left = tokenizer.encode(text[start:stop], add_special_tokens=False)
    skip = 0
    while stop < n:
        width, marks = overlap, _boundaries(left, start)
        while True:
            nxt = max(start, stop - width)
            end = min(n, stop + chunk)
            right = tokenizer.encode(text[nxt:end], add_special_tokens=False)
            theirs = _boundaries(right, nxt)
            shared = [o for o, (e, k) in marks.items() if nxt < o and e < stop - MARGIN and k >= skip and theirs.get(o, (0, 0))[0] == e]
            if shared:
                o = max(shared)
                total += marks[o][1] - skip
                start, stop, left, skip = nxt, end, right, theirs[o][1]
                break
            if nxt == start:  # nothing to splice at: take the chunk and its successor as one
                stop, left = end, tokenizer.encode(text[start:end], add_special_tokens=False)
                break
            width *= 2
    return total + len(left) - skip


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, chunk_chars: int = 32_768, overlap: int = 1_024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer_path)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                texts = part.column("text").to_pylist()
                counts = [0] * len(texts)
                short = [i for i, t in enumerate(texts) if len(t) <= chunk_chars]
                for at in range(0, len(short), 64):
                    rows = short[at : at + 64]
                    for i, e in zip(rows, tok.encode_batch_fast([texts[i] for i in rows], add_special_tokens=False), strict=True):
                        counts[i] = len(e)
                for i, t in enumerate(texts):
                    if len(t) > chunk_chars:
                        counts[i] = count_long(tok, t, chunk_chars, overlap)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from weftline.llm.common import table

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
