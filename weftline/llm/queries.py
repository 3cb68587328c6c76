"""The queries of the training-data operators, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from weftline.llm import collocations, fill_in_middle, warc
from weftline.llm.collocations import op12_collocations
from weftline.llm.fill_in_middle import op11_fill_in_middle
from weftline.llm.jaccard_join import op10_jaccard_join
from weftline.llm.language_id import op7_language_id
from weftline.llm.media import op9_media
from weftline.llm.packing import op6_packing
from weftline.llm.quality import op4_quality_rules
from weftline.llm.sentence_pieces import op8_sentence_pieces
from weftline.llm.substring_dedup import op5_substring_dedup
from weftline.llm.suffix_dedup import op1_suffix_dedup
from weftline.llm.token_counts import op3_token_counts
from weftline.llm.toxicity import op2_toxicity
from weftline.llm.warc import op13_warc

#: Every string of 50 bytes by its place; those that a smaller doc_id has too make the removed runs.
SUFFIX_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (SELECT doc_id, a, substr(h, 2 * a + 1, 498) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49, 200)) AS a FROM d)),
p AS (SELECT doc_id, a + j AS i, hash(substr(s, 2 * j + 1, 100)) AS g FROM (SELECT doc_id, a, s, unnest(range(0, least(200, len(s) // 2 - 49))) AS j FROM blocks)),
hit AS (SELECT doc_id, i FROM p JOIN (SELECT g, min(doc_id) AS least FROM p GROUP BY g) USING (g) WHERE least < doc_id),
marked AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS new FROM hit),
numbered AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
runs AS (SELECT doc_id, min(i) AS s, max(i) + 50 AS e FROM numbered GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS a, s AS b FROM runs
  UNION ALL SELECT d.doc_id, coalesce(max(e), 0), any_value(len(h) // 2) FROM d LEFT JOIN runs USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS k FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(e - s) AS n, count(*) AS m FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(m, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""

#: All pairs of documents that share a shingle, their overlap, and the components of those that link.
JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS shingles FROM words),
n AS (SELECT doc_id, len(shingles) AS n FROM sets),
tokens AS (SELECT doc_id, hash(unnest(shingles)) AS t FROM sets),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
pairs AS (SELECT x, y FROM both_ JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (SELECT doc_id AS node, doc_id AS other FROM n UNION SELECT node, y FROM reach JOIN links ON other = x)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, least AS component_id FROM n JOIN (SELECT node, min(other) AS least FROM reach GROUP BY node) ON node = n.doc_id
"""


def queries() -> dict:
    found = [op1_suffix_dedup, op2_toxicity, op3_token_counts, op4_quality_rules, op5_substring_dedup, op6_packing, op7_language_id, op8_sentence_pieces, op9_media, op10_jaccard_join, op11_fill_in_middle, op12_collocations, op13_warc]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": SUFFIX_SQL, "op10_jaccard_join": JACCARD_SQL, "op11_fill_in_middle": fill_in_middle.SQL, "op12_collocations": collocations.SQL, "op13_warc": warc.SQL}
