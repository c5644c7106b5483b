"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .codes import op11_vector_codes
from .decontam import op7_decontamination
from .embeddings import op10_embeddings
from .langid import op2_language_id
from .mixing import op9_mixing
from .pii import op4_pii
from .quality import op13_quality
from .search import op12_search
from .secrets import op1_secrets
from .sharding import op5_sharding
from .simhash import op3_simhash
from .tokens import op8_tokens
from .toxicity import op6_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_language_id": op2_language_id,
    "op3_simhash": op3_simhash,
    "op4_pii": op4_pii,
    "op5_sharding": op5_sharding,
    "op6_toxicity": op6_toxicity,
    "op7_decontamination": op7_decontamination,
    "op8_tokens": op8_tokens,
    "op9_mixing": op9_mixing,
    "op10_embeddings": op10_embeddings,
    "op11_vector_codes": op11_vector_codes,
    "op12_search": op12_search,
    "op13_quality": op13_quality,
}

#: Windows of 13 words (or a whole shorter item) found by joining every window with every other.
DECONTAMINATION = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
lens AS (SELECT DISTINCT least(len(w), 13) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN lens WHERE len(w) >= n)),
hits AS (SELECT doc_id, n, i, item_id FROM dw JOIN bw USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS listed FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: Each source in order of its rows' exponential keys, with prefix sums over the whole source.
MIXING = r"""
WITH q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
d AS (SELECT d.doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
-ln((('0x' || substr(md5('17:' || coalesce(d.doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / CASE WHEN quality >= 1 THEN 2.0 WHEN quality <= 0 THEN 0.5 ELSE 1.0 END AS key
FROM documents d LEFT JOIN q ON d.doc_id = q.doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (ARRAY[5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER t AS k, coalesce(sum(3 * source_size) OVER (t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
sum(w) OVER (t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free, sum(source_size) OVER () AS total FROM s WINDOW t AS (ORDER BY source_size / w::DOUBLE, w, source)),
l AS (SELECT min_by((total - held)::DOUBLE / free::DOUBLE, k) AS level FROM o WHERE w * ((total - held)::DOUBLE / free::DOUBLE) <= 3 * source_size),
g AS (SELECT source, source_size, least(w * level, 3.0 * source_size) AS target FROM s CROSS JOIN l),
h AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM g),
r AS (SELECT *, round(target - epochs * source_size)::BIGINT AS rest FROM h),
p AS (SELECT d.*, r.source_size, r.target, r.epochs, r.rest, sum(size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id, size ROWS UNBOUNDED PRECEDING) - size AS prefix FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, round(target, 6) AS target, (size * epochs + greatest(0, least(size, rest - prefix)))::BIGINT AS taken FROM p
"""

#: Every document's score for every item, in doubles only where the logarithm is taken.
SEARCH = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS t FROM documents),
b AS MATERIALIZED (SELECT row_number() OVER () AS q, item_id, list_distinct(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS t FROM benchmark),
g AS (SELECT count(*)::BIGINT AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
p AS MATERIALIZED (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term) CROSS JOIN g),
m AS (SELECT r, doc_id, 50 + (50 * len(t) * n_docs) // n_terms AS m FROM d CROSS JOIN g WHERE len(t) > 0),
s AS (SELECT q, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM (SELECT q, unnest(t) AS term FROM b) JOIN f USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY q, r),
k AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s JOIN m USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k JOIN b USING (q) WHERE rank <= 50
"""


def _codes(rounds: int = 6) -> str:
    """The rounds of the codebooks, one after the other, all distances computed."""
    usable = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    distance = "list_sum(list_transform(list_zip(p.z, b.z), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS z FROM embeddings WHERE {usable})",
        "p AS MATERIALIZED (SELECT r, k, z[k * (len(z) // 8) + 1 : (k + 1) * (len(z) // 8)] AS z FROM v CROSS JOIN range(8) t(k))",
        "b0 AS MATERIALIZED (SELECT k, e - 1 AS e, z FROM p JOIN (SELECT r, row_number() OVER (ORDER BY vec_id, z) AS e FROM v WHERE vec_id IS NOT NULL) USING (r) WHERE e <= 16)",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, k, min_by(e, (d, e)) AS e, min(d) AS d FROM (SELECT p.r, p.k, b.e, {distance} AS d FROM p JOIN b{i} b ON p.k = b.k) GROUP BY r, k)")
        if i < rounds:
            sums = f"SELECT k, e, j, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT p.k, a.e, unnest(p.z) AS x, unnest(range(len(p.z))) AS j FROM p JOIN a{i} a ON p.r = a.r AND p.k = a.k) GROUP BY ALL"
            parts.append(f"b{i + 1} AS MATERIALIZED (SELECT b.k, b.e, coalesce(c.z, b.z) AS z FROM b{i} b LEFT JOIN (SELECT k, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS z FROM ({sums}) GROUP BY k, e) c ON b.k = c.k AND b.e = c.e)")
    parts.append(f"c AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY k) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r)")
    parts.append(f"h AS (SELECT sha256(string_agg(array_to_string(z, ','), ',' ORDER BY k, e)) AS codebooks_sha256 FROM b{rounds})")
    return f"WITH {', '.join(parts)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN v USING (r) CROSS JOIN h"


ORACLE_SQL: dict[str, str] = {"op7_decontamination": DECONTAMINATION, "op9_mixing": MIXING, "op11_vector_codes": _codes(), "op12_search": SEARCH}
