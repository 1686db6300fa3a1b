"""The queries of this subpackage, as __spark_entry__.py registers them, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.spread import spread_sql
from . import audio, fingerprints, licenses, mixing, neardup, packing, passages, quality, sharding, toxicity
from ._tables import documents


def _on_documents(op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": _on_documents(fingerprints.op1),
    "op2_substring_dedup": passages.query,
    "op3_license_scans": licenses.query,
    "op4_telephony_audio": audio.query,
    "op5_best_fit_packing": packing.query,
    "op6_bagminhash": neardup.query,
    "op7_external_shuffle": sharding.query,
    "op8_toxicity": toxicity.query,
    "op9_quality": quality.query,
    "op10_fair_queueing": _on_documents(mixing.op10),
}

_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0d]+'), lambda x: x <> '')"

_PASSAGES = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
k AS MATERIALIZED (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM d, unnest(range(1, greatest(len(w) - 11, 1))) t(i) WHERE doc_id IS NOT NULL),
f AS (SELECT k, min(doc_id) AS first FROM k GROUP BY k),
gone AS MATERIALIZED (SELECT DISTINCT r, i + o AS j FROM k JOIN f USING (k), range(0, 13) t(o) WHERE first < doc_id),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS line FROM words ANTI JOIN gone USING (r, j) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""

_ROUNDS = 12
_LABELS = ", ".join(f"c{i} AS MATERIALIZED (SELECT id, min(x) AS x FROM (SELECT id, x FROM c{i - 1} UNION ALL SELECT b, x FROM c{i - 1} JOIN both_ways ON id = a) z GROUP BY 1)" for i in range(1, _ROUNDS + 1))
_GROUPS = f"""WITH d AS MATERIALIZED (SELECT DISTINCT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
rep AS MATERIALIZED (SELECT w, min(doc_id) AS rep_id FROM d GROUP BY w),
bag AS MATERIALIZED (SELECT rep_id, g, count(*) AS c FROM (SELECT rep_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM rep) s GROUP BY 1, 2),
size AS MATERIALIZED (SELECT rep_id, sum(c) AS n FROM bag GROUP BY 1),
near AS MATERIALIZED (SELECT a, b FROM (SELECT x.rep_id AS a, y.rep_id AS b, sum(least(x.c, y.c)) AS o FROM bag x JOIN bag y ON x.g = y.g AND x.rep_id < y.rep_id GROUP BY 1, 2) p
JOIN size s ON a = s.rep_id JOIN size t ON b = t.rep_id WHERE CAST(o AS DOUBLE) / CAST(s.n + t.n - o AS DOUBLE) >= {neardup.THRESHOLD}),
both_ways AS MATERIALIZED (SELECT a, b FROM near UNION ALL SELECT b, a FROM near), c0 AS MATERIALIZED (SELECT rep_id AS id, rep_id AS x FROM rep), {_LABELS}
SELECT doc_id, x AS class_id, rep_id FROM d JOIN rep USING (w) JOIN c{_ROUNDS} ON rep_id = id"""

_SHARES = ["t0 AS MATERIALIZED (SELECT source, n, (ARRAY[1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE])[1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS weight, CAST(NULL AS DOUBLE) AS cut FROM totals)"]
for _i in range(8):  # sources that reach three times their size get that; what they leave is shared again
    _left = f"(SELECT CAST(sum(n) AS DOUBLE) - coalesce(sum(cut), 0) FROM t{_i}) * weight / (SELECT sum(weight) FROM t{_i} WHERE cut IS NULL)"
    _SHARES.append(f"t{_i + 1} AS MATERIALIZED (SELECT source, n, weight, CASE WHEN cut IS NULL AND {_left} > 3.0::DOUBLE * n THEN 3.0::DOUBLE * n ELSE cut END AS cut FROM t{_i})")
_MIX = f"""WITH s AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
totals AS MATERIALIZED (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM s GROUP BY 1), {", ".join(_SHARES)},
goal AS MATERIALIZED (SELECT source, n, coalesce(cut, {_left.replace("t7", "t8")}) AS target FROM t8),
q AS MATERIALIZED (SELECT r, doc_id, size, n, target, key, CAST(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
FROM (SELECT *, {spread_sql(mixing.DRAWN, mixing.SEED)} AS key FROM s) s JOIN goal ON s.source IS NOT DISTINCT FROM goal.source),
runs AS (SELECT r, size, sum(size) OVER (ORDER BY CAST(e * n + upto AS DOUBLE) / target, key, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM q, range(0, 3) t(e) WHERE size > 0 AND target > 0),
took AS (SELECT r, CAST(sum(size) AS BIGINT) AS taken FROM runs WHERE total <= (SELECT sum(n) FROM totals) GROUP BY r)
SELECT doc_id, size, n AS source_size, target, coalesce(taken, 0) AS taken FROM q LEFT JOIN took USING (r)"""

#: The others' digests can't be computed in SQL with the same hashes, models or draws; tests hold each against a plain
#: version in Python, these as well.
ORACLES: dict[str, str] = {"op2_substring_dedup": _PASSAGES, "op6_bagminhash": _GROUPS, "op10_fair_queueing": _MIX}
