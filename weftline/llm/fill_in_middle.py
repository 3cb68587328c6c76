"""Fill-in-the-middle transformation of whole texts, cut at units found by run-length classes.

A text's UTF-8 bytes are put into character classes (for lines: line feed or not) and stored as
maximal runs of one class, each with the units that have ended by its end. The cut after u units is
found by binary search for the run in which unit u ends; within that run its place is arithmetic:
in a run of line feeds every byte ends a unit, any other run that ends a unit ends it with its last
byte. No unit is ever listed, so a text of many lines costs its runs only.

Units (``unit``):

* ``line``: ``[^\\n]*\\n|[^\\n]+``, matched left to right;
* ``word``: maximal runs of ``[^\\x20\\x09-\\x0D]`` or of the other characters;
* ``char``: code points.

Cuts and form come from the sha256 of ``seed:doc_id`` (a null id: ``seed:null``), so a row's result
never depends on other rows or on the partitioning. Null texts count as empty. Texts that are empty
or hold a marker are plain. Repeated ids and equal rows stay one row each. An empty table gives no
rows. Extra columns of the input are not carried, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import slices, text_or_empty

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Class 1 of each unit kind: for lines the line feed, for words white space, for characters bytes that continue one.
_CLASSES = {"line": np.zeros(256, np.uint8), "word": np.zeros(256, np.uint8), "char": np.zeros(256, np.uint8)}
_CLASSES["line"][10] = 1
_CLASSES["word"][[32, *range(9, 14)]] = 1
_CLASSES["char"][128:192] = 1


class Runs:
    """Maximal class runs of a text with cumulative unit counts."""

    def __init__(self, data: bytes, unit: str = "line"):
        self.unit, self.size = unit, len(data)
        marks = _CLASSES[unit][np.frombuffer(data, np.uint8)]
        edges = np.flatnonzero(marks[1:] != marks[:-1]) + 1
        self.starts = np.concatenate(([0], edges)) if len(data) else np.zeros(0, np.int64)
        self.ends = np.concatenate((edges, [len(data)])) if len(data) else np.zeros(0, np.int64)
        lengths, special = self.ends - self.starts, marks[self.starts] == 1
        if unit == "line":  # each line feed ends a unit; so does the end of a text without one
            ended = np.where(special, lengths, 0)
            if len(data) and not special[-1]:
                ended[-1] = 1
        elif unit == "word":
            ended = np.ones(len(lengths), np.int64)
        else:  # a character begins at each byte of class 0
            ended = np.where(special, 0, lengths)
        self.special, self.ended = special, np.cumsum(ended)

    @property
    def units(self) -> int:
        return int(self.ended[-1]) if len(self.ended) else 0

    def offset(self, u: int) -> int:
        """The byte after the first u units."""
        if u <= 0:
            return 0
        if self.unit == "char":  # where character u + 1 begins: it is counted there, not where u ends
            if u >= self.units:
                return self.size
            k = int(np.searchsorted(self.ended, u + 1))
            return int(self.starts[k]) + u - (int(self.ended[k - 1]) if k else 0)
        k = int(np.searchsorted(self.ended, u))
        if self.unit == "line" and self.special[k]:
            return int(self.starts[k]) + u - (int(self.ended[k - 1]) if k else 0)
        return int(self.ends[k])


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """The first four 8-digit groups of the sha256 of seed:doc_id."""
    h = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(h[8 * k : 8 * k + 8], 16) for k in range(4))


def arrange(data: bytes, doc_id: int | None, seed: int, rate: int, spm_rate: int, unit: str) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, prefix and middle in code points, output) of one text."""
    runs = Runs(data, unit)
    n, (h1, h2, h3, h4) = runs.units, draws(seed, doc_id)
    if not data or h3 % 100 >= rate or any(m.encode() in data for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, data
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    i, j = runs.offset(a), runs.offset(b)
    prefix, middle, suffix = data[:i], data[i:j], data[j:]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if h4 % 100 < spm_rate:
        form, out = "spm", s + suffix + p + prefix + m + middle
    else:
        form, out = "psm", p + prefix + s + suffix + m + middle
    return n, form, len(prefix.decode()), len(middle.decode()), out


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, unit: str = "line") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of each row of docs (doc_id, text).

    rate percent of the texts are transformed, spm_rate percent of those into suffix-prefix-middle order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                ids = part.column("doc_id").to_pylist()
                texts = part.column("text").cast(pa.binary()).to_pylist()
                made = [arrange(t, d, seed, rate, spm_rate, unit) for d, t in zip(ids, texts, strict=True)]
                if made:
                    *columns, out = zip(*made, strict=True)
                    arrays = [part.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array(out, pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: str | Column = "form", output: str | Column = "output") -> Column:
    """The text that transform() took, from its form and output alone.

    A transformed text holds no marker, and no marker can begin within another or within a text and
    reach into one, so the first place of each marker is the one that was written.
    """
    form, output = (F.col(c) if isinstance(c, str) else c for c in (form, output))
    head = F.split_part(output, F.lit(MIDDLE), F.lit(1))
    middle = F.split_part(output, F.lit(MIDDLE), F.lit(2))
    # head is one marker, x, another marker, y: in psm x is the prefix, in spm the suffix
    between = F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    x = F.split_part(F.substring(head, F.lit(len(PREFIX) + 1), F.length(head)), between, F.lit(1))
    y = F.split_part(head, between, F.lit(2))
    return F.when(form == "plain", output).when(form == "psm", F.concat(x, middle, y)).otherwise(F.concat(y, middle, x))


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    from weftline.llm.common import table

    return digest(transform(table(spark, sf_dir, "documents")))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
cuts AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
placed AS (
  SELECT doc_id, text, lines, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM cuts),
parts AS (SELECT doc_id, text, n, form, array_to_string(lines[1:a], '') AS p, array_to_string(lines[a + 1:b], '') AS m, array_to_string(lines[b + 1:], '') AS s FROM placed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
