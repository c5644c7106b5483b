"""DuckDB SQL for the queries, written densely: every draft with every card and group."""

from __future__ import annotations

from ..functions import twister
from .queries import BOOT, SPLIT_SEED, part_cards_sql

Z = 1.959963984540054
COLORS = "WUBRG"

FACTS = """
raw AS (SELECT o_custkey AS draft_id, p_brand AS card, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS rn
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
picks AS (SELECT draft_id, rn // 10 AS pack, rn % 10 AS pick_no, card FROM raw WHERE rn < 30),
nos AS (SELECT DISTINCT p_brand AS card, split_part(p_brand, '#', 2)::INT AS no FROM part),
cards AS (SELECT card, no, 'WUBRG'[(no % 5 + 1)] AS group_b, CASE WHEN no % 4 = 0 THEN 'WUBRG'[((no + 2) % 5 + 1)] ELSE '' END AS second, 1 + no % 3 AS pips, no % 7 AS mv,
  (no % 5 = 0)::INT AS rare, (no % 9 = 0)::INT AS land, (no % 2 = 0)::INT AS creature FROM nos),
groups AS (SELECT DISTINCT group_b FROM cards),
lens AS (SELECT draft_id, pack, count(*) AS n FROM picks GROUP BY ALL),
drafts AS (SELECT draft_id, coalesce(max(n) FILTER (pack = 0), 0) AS p0, coalesce(max(n) FILTER (pack = 1), 0) AS p1, coalesce(max(n) FILTER (pack = 2), 0) AS p2, max(n) AS mx,
  draft_id IN (SELECT draft_id FROM picks WHERE pack = 1 AND pick_no = 0) AS reached FROM lens GROUP BY draft_id),
valid AS (SELECT draft_id, p2 AS horizon FROM drafts WHERE reached AND p0 = mx AND p1 = mx AND p2 = mx),
taken AS (SELECT draft_id, card FROM picks WHERE pack = 1 AND pick_no = 0),
offers AS (SELECT draft_id, card, count(*) AS copies FROM picks WHERE pack = 1 GROUP BY ALL),
held AS (SELECT DISTINCT draft_id, card FROM picks WHERE pack = 0),
units AS (SELECT v.draft_id, c.card AS card_a, v.horizon, coalesce(o.copies = 1, false)::INT AS z, coalesce(o.copies > 0, false)::INT AS zpos, (t.card = c.card)::INT AS t
  FROM valid v CROSS JOIN cards c LEFT JOIN offers o ON o.draft_id = v.draft_id AND o.card = c.card JOIN taken t ON t.draft_id = v.draft_id
  WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.draft_id = v.draft_id AND h.card = c.card)),
ycnt AS (SELECT v.draft_id, g.group_b, count(p.card) FILTER (p.pack = 2) AS y, count(p.card) FILTER (p.pack = 0) AS x
  FROM valid v CROSS JOIN groups g LEFT JOIN (SELECT draft_id, pack, card, group_b FROM picks JOIN cards USING (card)) p ON p.draft_id = v.draft_id AND p.group_b = g.group_b GROUP BY ALL)
"""

STATS = FACTS + """,
stats AS (SELECT card_a, group_b, z, count(*) AS n, sum(z * t)::BIGINT AS sum_d, sum(y)::BIGINT AS sum_y, sum(y * y)::BIGINT AS sum_y_sq, sum(z * t * y)::BIGINT AS sum_dy
  FROM units JOIN ycnt USING (draft_id) GROUP BY ALL)
"""

ACCOUNTING = """,
acc AS (SELECT c.card AS card_a, count(u.draft_id) AS n_valid, (SELECT count(*) FROM valid) - count(u.draft_id) AS n_invalid,
  (SELECT count(*) FROM drafts WHERE reached) - (SELECT count(*) FROM valid) AS n_incomplete, 0::BIGINT AS n_no_outcome, coalesce(sum(u.z), 0)::BIGINT AS n_offered, coalesce(sum(u.z * u.t), 0)::BIGINT AS n_treated,
  coalesce(sum(u.horizon), 0)::BIGINT AS horizon_total, round(avg(u.horizon), 6) AS horizon_mean, (SELECT min(horizon) FROM valid) AS horizon_min, (SELECT max(horizon) FROM valid) AS horizon_max
  FROM cards c LEFT JOIN units u ON u.card_a = c.card GROUP BY c.card)
"""

_TAIL = "(0.5 * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x))"

EFFECTS = STATS + ACCOUNTING + f""",
arms AS (SELECT a.card_a, a.group_b, a.n::DOUBLE AS n1, a.sum_y::DOUBLE / a.n AS y1, a.sum_d::DOUBLE / a.n AS d1, a.sum_y_sq::DOUBLE AS q1, a.sum_dy::DOUBLE AS dy1, b.n::DOUBLE AS n0, b.sum_y::DOUBLE / b.n AS y0, b.sum_y_sq::DOUBLE AS q0
  FROM stats a JOIN stats b USING (card_a, group_b) WHERE a.z = 1 AND b.z = 0 AND a.n >= 2 AND b.n >= 2 AND a.sum_d > 0),
est AS (SELECT card_a, group_b, y1 - y0 AS itt_y, d1 AS itt_d, (y1 - y0) / d1 AS late,
  sqrt(greatest(0, ((q1 - n1 * y1 * y1) / (n1 - 1) / n1 + (q0 - n0 * y0 * y0) / (n0 - 1) / n0) / (d1 * d1) + (y1 - y0) ** 2 * (d1 * (1 - d1) / n1) / d1 ** 4 - 2 * (y1 - y0) * ((dy1 - n1 * y1 * d1) / (n1 - 1) / n1) / d1 ** 3)) AS se_late FROM arms),
zs AS (SELECT *, CASE WHEN se_late > 0 THEN late / se_late ELSE 0 END AS z_stat FROM est),
xs AS (SELECT *, abs(z_stat) / sqrt(2.0) AS x, 1 / (1 + 0.3275911 * abs(z_stat) / sqrt(2.0)) AS t FROM zs),
effects AS (SELECT card_a, group_b, itt_y, itt_d, late, se_late, z_stat, 2 * {_TAIL} AS p_value FROM xs)
"""

SCORING = EFFECTS + """,
satts AS (SELECT card_a, group_b, avg(y) FILTER (t = 1) - avg(y) FILTER (t = 0) AS satt, avg(y) FILTER (t = 1) - avg(y) FILTER (t = 0 AND zpos = 1) AS satt_offered FROM units JOIN ycnt USING (draft_id) GROUP BY ALL),
scoring AS (SELECT method, card_a, group_b, late, se_late, value FROM (
  SELECT 'satt' AS method, e.card_a, e.group_b, late, se_late, satt AS value FROM effects e LEFT JOIN satts s USING (card_a, group_b)
  UNION ALL SELECT 'satt_offered', e.card_a, e.group_b, late, se_late, satt_offered FROM effects e LEFT JOIN satts s USING (card_a, group_b)
  UNION ALL SELECT 'null_zero', card_a, group_b, late, se_late, 0 FROM effects
  UNION ALL SELECT 'null_mean', card_a, group_b, late, se_late, (SELECT avg(late) FROM effects) FROM effects)),
rows_ AS (SELECT *, value - late AS d, (se_late > 0)::INT AS hs, (se_late > 0 AND abs(value - late) <= 1.959963984540054 * se_late)::INT AS cv FROM scoring WHERE value IS NOT NULL)
"""


def q(*columns: str) -> str:
    """Columns rounded to six digits."""
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in columns)


def scored(w: str = "1", e: str = "value", d: str = "d", c: str = "cv") -> str:
    """Metrics as weighted aggregates over rows."""
    m = lambda x: f"(sum({w} * ({x})) / sum({w}))"
    spread = f"({m(f'{e} * {e}')} - {m(e)} ** 2 + {m('late * late')} - {m('late')} ** 2 + ({m(e)} - {m('late')}) ** 2)"
    return (f"sqrt({m(f'{d} * {d}')}) AS rmse, {m(f'abs({d})')} AS mae, CASE WHEN sum({w}) >= 2 AND {spread} > 1e-18 THEN 2 * ({m(f'{e} * late')} - {m(e)} * {m('late')}) / {spread} END AS ccc, "
            f"sum({w} * {c}) / nullif(sum({w} * hs)::DOUBLE, 0) AS accuracy95")


def draws(clusters: str, seed: int = 0) -> str:
    """CTEs ``idx`` and ``wts``: how often each cluster is drawn in each replicate."""
    return f""",
idx AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS i, count(*) OVER () AS k FROM ({clusters})),
hits AS (SELECT rep, ('0x' || substring(md5('{seed}:' || rep || ':' || i), 1, 8))::BIGINT % k AS i FROM idx CROSS JOIN range({BOOT}) r(rep)),
wts AS (SELECT cluster, rep, count(*) AS w FROM hits JOIN idx USING (i) GROUP BY ALL)
"""


def intervals(cluster: str) -> str:
    spans = ", ".join(f"round(quantile_cont({m}, 0.025), 6) + 0.0 AS {m}_lo, round(quantile_cont({m}, 0.975), 6) + 0.0 AS {m}_hi, round((quantile_cont({m}, 0.975) - quantile_cont({m}, 0.025)) / 2, 6) + 0.0 AS {m}_sci" for m in ("rmse", "mae", "ccc", "accuracy95"))
    return f"""WITH {SCORING}, clustered AS (SELECT *, {cluster} AS cluster FROM rows_) {draws("SELECT DISTINCT cluster FROM clustered")},
reps AS (SELECT method, rep, {scored("w")} FROM clustered JOIN wts USING (cluster) GROUP BY ALL)
SELECT method, {spans}, least(count(rmse), count(mae), count(ccc), count(accuracy95)) AS n_boot_used FROM reps GROUP BY method"""


_ORIENT = {"rmse": -1, "mae": -1, "ccc": 1, "accuracy95": 1}


MATRIX = f"""WITH {SCORING} {draws("SELECT DISTINCT card_a AS cluster FROM rows_")},
both_ AS (SELECT a.method AS method_a, b.method AS method_b, a.card_a AS cluster, a.late, a.hs, a.value AS v1, a.d AS d1, a.cv AS c1, b.value AS v2, b.d AS d2, b.cv AS c2 FROM rows_ a JOIN rows_ b ON a.card_a = b.card_a AND a.group_b = b.group_b AND a.method < b.method),
seen1 AS (SELECT method_a, method_b, count(*) AS n_pairs, count(DISTINCT cluster) AS n_clusters, {scored("1", "v1", "d1", "c1")} FROM both_ GROUP BY ALL),
seen2 AS (SELECT method_a, method_b, {scored("1", "v2", "d2", "c2")} FROM both_ GROUP BY ALL),
rep1 AS (SELECT method_a, method_b, rep, {scored("w", "v1", "d1", "c1")} FROM both_ JOIN wts USING (cluster) GROUP BY ALL),
rep2 AS (SELECT method_a, method_b, rep, {scored("w", "v2", "d2", "c2")} FROM both_ JOIN wts USING (cluster) GROUP BY ALL),
obs AS ({" UNION ALL ".join(f"SELECT method_a, method_b, n_pairs, n_clusters, '{m}' AS metric, {o} * (a.{m} - b.{m}) AS o FROM seen1 a JOIN seen2 b USING (method_a, method_b)" for m, o in _ORIENT.items())}),
signs AS (SELECT *, CASE WHEN abs(o) > 1e-12 THEN sign(o) ELSE 0 END AS s FROM obs),
diffs AS ({" UNION ALL ".join(f"SELECT method_a, method_b, '{m}' AS metric, {o} * (a.{m} - b.{m}) AS d FROM rep1 a JOIN rep2 b USING (method_a, method_b, rep)" for m, o in _ORIENT.items())}),
tests AS (SELECT g.*, count(d) FILTER (d * s <= 1e-12) AS crossings, count(d) AS nf FROM signs g LEFT JOIN diffs USING (method_a, method_b, metric) GROUP BY ALL),
ps AS (SELECT *, CASE WHEN s <> 0 AND nf >= 2 THEN least(1.0, 2.0 * (crossings + 1) / (nf + 1)) END AS p FROM tests),
rk AS (SELECT *, row_number() OVER (PARTITION BY metric, p IS NULL ORDER BY p, method_a, method_b) AS r, count(*) OVER (PARTITION BY metric, p IS NULL) AS n FROM ps),
adj AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1.0, min(p * n / r) OVER (PARTITION BY metric, p IS NULL ORDER BY r DESC)) END AS q, coalesce(max(CASE WHEN p <= 0.05 * r / n THEN r END) OVER (PARTITION BY metric, p IS NULL), 0) AS last FROM rk),
matrix AS (SELECT method_a, method_b, metric, n_pairs, n_clusters, CASE WHEN p IS NOT NULL AND r <= last AND s > 0 THEN '>' WHEN p IS NOT NULL AND r <= last AND s < 0 THEN '<' ELSE '~' END AS symbol, p, q FROM adj)
"""

HISTORY = FACTS + f""",
hp AS (SELECT p.draft_id, c.* FROM picks p JOIN valid USING (draft_id) LEFT JOIN cards c ON c.card = p.card WHERE p.pack = 0),
hist AS (SELECT draft_id, count(*) AS n_prior, count(*) FILTER (land = 0) AS n_spells, count(*) FILTER (land = 1) AS n_lands, sum(rare)::BIGINT AS n_rares, sum(creature)::BIGINT AS n_creatures,
  {", ".join(f"count(*) FILTER (group_b = '{c}' OR second = '{c}') AS n_{c}, sum(CASE WHEN group_b = '{c}' THEN pips ELSE 0 END + CASE WHEN second = '{c}' THEN 1 ELSE 0 END)::BIGINT AS pips_{c}, count(*) FILTER (land = 1 AND (group_b = '{c}' OR second = '{c}')) AS fix_{c}" for c in COLORS)},
  {", ".join(f"count(*) FILTER (land = 0 AND mv BETWEEN {lo} AND {hi}) AS {n}" for n, lo, hi in (("n_mv1", 0, 1), ("n_mv2", 2, 2), ("n_mv3", 3, 3), ("n_mv4", 4, 4), ("n_mv5", 5, 5), ("n_mv6plus", 6, 99)))},
  coalesce(sum(mv) FILTER (land = 0), 0) / nullif(count(*) FILTER (land = 0), 0)::DOUBLE AS avg0 FROM hp GROUP BY draft_id),
hist2 AS (SELECT * EXCLUDE (avg0), coalesce(avg0, 0.0) AS avg_cmc, {" + ".join(f"(n_{c} > 0)::INT" for c in COLORS)} AS num_colors, {" + ".join(f"(pips_{c} >= 3)::INT" for c in COLORS)} AS num_colors_committed, {" + ".join(f"pips_{c}" for c in COLORS)} AS pips_total FROM hist)
"""

_ON = {c: f"(k.group_b = '{c}' OR k.second = '{c}')" for c in COLORS}
FRAME = HISTORY + f""",
frame AS (SELECT u.draft_id, u.card_a, u.t AS "T", 1 - u.zpos AS not_offered, u.horizon, h.n_prior, h.n_lands, h.n_rares, h.n_creatures, h.num_colors, h.num_colors_committed, h.avg_cmc,
  ({" + ".join(f"CASE WHEN {_ON[c]} THEN pips_{c} ELSE 0 END" for c in COLORS)}) AS n_oncolor_pips, ({" + ".join(f"CASE WHEN {_ON[c]} THEN fix_{c} ELSE 0 END" for c in COLORS)}) AS n_fix_oncolor,
  greatest({", ".join(f"CASE WHEN {_ON[c]} THEN 0 ELSE pips_{c} END" for c in COLORS)}) AS off, CASE WHEN k.second NOT IN ('', k.group_b) THEN least({", ".join(f"CASE WHEN {_ON[c]} THEN pips_{c} END" for c in COLORS)}) ELSE 0 END AS low, greatest(pips_total, 1) AS tot
  FROM units u JOIN hist2 h USING (draft_id) JOIN cards k ON k.card = u.card_a),
rel AS (SELECT *, n_oncolor_pips / tot::DOUBLE AS oncolor_pip_share, low / tot::DOUBLE AS oncolor_pip_min_share, off / tot::DOUBLE AS offcolor_pip_share FROM frame)
"""

CORE = ("oncolor_pip_share", "oncolor_pip_min_share", "n_oncolor_pips", "offcolor_pip_share", "avg_cmc", "n_fix_oncolor", "num_colors_committed", "n_rares")

BALANCE = FACTS + """,
bs AS (SELECT card_a, group_b, count(*) FILTER (z = 1) AS n_z1, count(*) FILTER (z = 0) AS n_z0, avg(x) FILTER (z = 1) AS mean_x_z1, avg(x) FILTER (z = 0) AS mean_x_z0, var_samp(x) FILTER (z = 1) AS var_x_z1, var_samp(x) FILTER (z = 0) AS var_x_z0,
  count(*) AS n_valid, (SELECT count(*) FROM valid) - count(*) AS n_invalid, sum(z)::BIGINT AS n_offered FROM units JOIN ycnt USING (draft_id) GROUP BY ALL),
bal AS (SELECT *, sqrt(var_x_z1) AS sd_x_z1, sqrt(var_x_z0) AS sd_x_z0, mean_x_z1 - mean_x_z0 AS mean_diff, sqrt((var_x_z1 + var_x_z0) / 2) AS pooled_sd, (mean_x_z1 - mean_x_z0) / nullif(sqrt((var_x_z1 + var_x_z0) / 2), 0) AS smd,
  abs((mean_x_z1 - mean_x_z0) / nullif(sqrt((var_x_z1 + var_x_z0) / 2), 0)) AS abs_smd, (SELECT count(*) FROM drafts WHERE reached) - (SELECT count(*) FROM valid) AS n_incomplete FROM bs)
"""

STATS_BY_CARD = FACTS + """,
pos AS (SELECT draft_id, pack, card, max(pick_no) + 1 AS n_rows FROM picks GROUP BY ALL),
off AS (SELECT card, count(*) FILTER (pack = 0) AS p1p1_offered, count(*) FILTER (pack = 1) AS p2p1_offered, count(*) FILTER (pack = 2) AS p3p1_offered, sum(n_rows)::BIGINT AS total_offered FROM pos GROUP BY card),
pk AS (SELECT card, count(*) FILTER (pack = 0 AND pick_no = 0) AS p1p1_picked, count(*) FILTER (pack = 1 AND pick_no = 0) AS p2p1_picked, count(*) FILTER (pack = 2 AND pick_no = 0) AS p3p1_picked, count(*) AS total_picked FROM picks GROUP BY card),
card_stats AS (SELECT card AS card_name, coalesce(p1p1_offered, 0) AS p1p1_offered, coalesce(p1p1_picked, 0) AS p1p1_picked, coalesce(p2p1_offered, 0) AS p2p1_offered, coalesce(p2p1_picked, 0) AS p2p1_picked, coalesce(p3p1_offered, 0) AS p3p1_offered, coalesce(p3p1_picked, 0) AS p3p1_picked, coalesce(total_offered, 0) AS total_offered, coalesce(total_picked, 0) AS total_picked
  FROM cards LEFT JOIN off USING (card) LEFT JOIN pk USING (card))
"""


def _part_cards() -> str:
    symbols = "list_filter(list_transform(string_split(replace(coalesce(mana_cost, ''), '}', '{'), '{'), lambda x: trim(x)), lambda x: x <> '')"
    return f"WITH meta AS ({part_cards_sql('[{}]')}), sym AS (SELECT *, {symbols} AS s FROM meta)"


def _sequence() -> str:
    """The generator's words by its recurrence, 227 at a time, and the top bit of each number of two words."""
    y = "y"
    for shift in ("xor({}, {} >> 11)", "xor({}, ({} << 7) & 2636928640)", "xor({}, ({} << 15) & 4022730752)", "xor({}, {} >> 18)"):
        y = shift.format(y, y)
    mixed = "((w[k] & 2147483648) | (w[k + 1] & 2147483647))"
    return f"""WITH RECURSIVE {FACTS}, size AS (SELECT count(*) AS n FROM drafts),
gen AS (SELECT 0 AS i, {twister.seeded(SPLIT_SEED).tolist()}::UBIGINT[] AS w
  UNION ALL SELECT i + 1, w[228:] || list_transform(range(1, 228), lambda k: xor(w[k + 397], xor({mixed} >> 1, (w[k + 1] & 1) * 2567483615::UBIGINT))) FROM gen, size WHERE i * 227 < 2 * n),
words AS (SELECT (i - 1) * 227 + j AS place, w[398 + j] AS y FROM gen, range(227) r(j) WHERE i > 0),
ids AS (SELECT draft_id, row_number() OVER (ORDER BY draft_id) - 1 AS position FROM drafts)
SELECT draft_id, (({y}) >> 31)::BIGINT AS half FROM ids JOIN words ON place = 2 * position"""


_Z = "greatest(coalesce(abs(v - b.mean) / sqrt((CASE WHEN se > 0 THEN se ELSE 1e-9 END) ** 2 + b.sd ** 2), 0), coalesce(abs(v - f.mean) / sqrt((CASE WHEN se > 0 THEN se ELSE 1e-9 END) ** 2 + f.sd ** 2), 0))"
_RANKED = f"""
v AS (SELECT card_a, group_b, late AS v, se_late AS se, row_number() OVER (ORDER BY late, card_a, group_b) - 1 AS rank, count(*) OVER () AS n FROM effects),
dr AS (SELECT rep, ('0x' || substring(md5('0:' || rep || ':' || rank), 1, 8))::BIGINT % n AS rank FROM v CROSS JOIN range({BOOT}) r(rep)),
ov AS (SELECT rep, v.v, row_number() OVER (PARTITION BY rep ORDER BY v.v) - 1 AS rank FROM dr JOIN v USING (rank)),
rs AS (SELECT rank, avg(v) AS mean, stddev_samp(v) AS sd FROM ov GROUP BY rank),
par AS (SELECT unnest([0.2, 0.4]::DOUBLE[]) AS step),
zz AS (SELECT step, v.card_a, v.group_b, v.rank, n, {_Z} AS z FROM v CROSS JOIN par LEFT JOIN rs b ON b.rank = v.rank - floor(n * step)::BIGINT LEFT JOIN rs f ON f.rank = v.rank + floor(n * step)::BIGINT)"""
_RSC = f"""WITH {EFFECTS}, {_RANKED} SELECT card_a, group_b, rank, round(z, 6) + 0.0 AS z, z > 2 AS keep FROM zz WHERE step = 0.2"""
_RSC_FDR = f"""WITH {EFFECTS}, {_RANKED},
tz AS (SELECT *, z / sqrt(2.0) AS x, 1 / (1 + 0.3275911 * z / sqrt(2.0)) AS t FROM zz WHERE step = 0.2), ps AS (SELECT *, 2 * {_TAIL} AS p FROM tz),
rk AS (SELECT *, row_number() OVER (ORDER BY p, rank) AS r FROM ps)
SELECT card_a, group_b, rank, round(z, 6) + 0.0 AS z, r <= coalesce(max(CASE WHEN p <= 0.3 * r / n THEN r END) OVER (), 0) AS keep FROM rk"""
_SWEEP = f"""WITH {SCORING}, {_RANKED},
share AS (SELECT step AS value, avg((z > 0.5)::INT) AS remaining FROM zz GROUP BY step),
m AS (SELECT -1.0::DOUBLE AS step, method, {scored()} FROM rows_ GROUP BY method UNION ALL SELECT step, method, {scored()} FROM rows_ JOIN zz USING (card_a, group_b) WHERE z > 0.5 GROUP BY step, method),
l AS ({" UNION ALL ".join(f"SELECT step AS value, method, '{m}' AS metric, round({m}, 9) AS x FROM m WHERE {m} IS NOT NULL" for m in _ORIENT)}),
r AS (SELECT *, rank() OVER (PARTITION BY metric, value ORDER BY x) + (count(*) OVER (PARTITION BY metric, value, x) - 1) / 2.0 AS rk FROM l),
rho AS (SELECT b.value, a.metric, covar_pop(a.rk, b.rk) / nullif(stddev_pop(a.rk) * stddev_pop(b.rk), 0) AS rho FROM r a JOIN r b ON a.metric = b.metric AND a.method = b.method AND a.value < 0 AND b.value > 0 GROUP BY ALL)
SELECT value, round(remaining, 6) + 0.0 AS remaining, {", ".join(f"round(max(rho) FILTER (metric = '{m}'), 6) + 0.0 AS {m}" for m in _ORIENT)} FROM share LEFT JOIN rho USING (value) GROUP BY value, remaining"""

_EXCLUSION = f"""WITH {FRAME}, fx AS (SELECT f.*, dense_rank() OVER (ORDER BY {", ".join(CORE)}) AS bucket FROM rel f WHERE "T" = 0),
b AS (SELECT card_a, bucket, group_b, count(*) FILTER (not_offered = 0) AS n1, count(*) FILTER (not_offered = 1) AS n0, avg(y) FILTER (not_offered = 1) AS m0 FROM fx JOIN ycnt USING (draft_id) GROUP BY ALL),
t AS (SELECT fx.card_a, ycnt.group_b, ycnt.y, b.m0 FROM fx JOIN ycnt USING (draft_id) JOIN b ON b.card_a = fx.card_a AND b.bucket = fx.bucket AND b.group_b = ycnt.group_b WHERE fx.not_offered = 0 AND b.n0 > 0),
m AS (SELECT card_a, group_b, count(*) AS n, avg(y) AS m1, avg(m0) AS m0, var_samp(y) AS v1, var_samp(m0) AS v0 FROM t GROUP BY ALL),
s AS (SELECT card_a, group_b, sum(n1)::BIGINT AS n_z1t0, coalesce(sum(n1) FILTER (n1 > 0 AND n0 > 0), 0)::BIGINT AS n_matched, sum(n0)::BIGINT AS n_z0_pool, coalesce(sum(n0) FILTER (n1 > 0 AND n0 > 0), 0)::BIGINT AS n_z0_used, count(*) FILTER (n1 > 0 AND n0 > 0) AS n_buckets FROM b GROUP BY ALL),
o AS (SELECT s.*, 1 - n_matched / nullif(n_z1t0, 0)::DOUBLE AS drop_ratio, n_z0_used / nullif(n_buckets, 0)::DOUBLE AS mean_bucket, CASE WHEN n >= 2 THEN m1 END AS mean_y_z1, CASE WHEN n >= 2 THEN m0 END AS mean_y_z0, v1 AS var_y_z1, v0 AS var_y_z0, sqrt(v1) AS sd_y_z1, sqrt(v0) AS sd_y_z0, CASE WHEN n >= 2 THEN m1 - m0 END AS mean_diff, sqrt((v1 + v0) / 2) AS pooled_sd, (m1 - m0) / nullif(sqrt((v1 + v0) / 2), 0) AS smd, abs((m1 - m0) / nullif(sqrt((v1 + v0) / 2), 0)) AS abs_smd FROM s LEFT JOIN m USING (card_a, group_b))"""

_YS = ", ".join(f'coalesce(max(y) FILTER (group_b = \'{g}\'), 0) AS "Y_{g}"' for g in "BGRUW")

def _newton(steps: int = 12) -> str:
    """Logistic fits of all cards on their offered rows, as Newton steps with a Gaussian elimination each.

    A step sums gradients and Hessians over ``ofr`` by card into an augmented matrix, which nine
    eliminations solve; nothing of it is shared with the fits that it checks.
    """
    k = len(CORE) + 1
    z = [f"z{i}" for i in range(k - 1)] + ["1.0"]
    parts = [
        f"""ofr AS MATERIALIZED (SELECT r.card_a, "T" AS t, {", ".join(f"({c} - avg({c}) OVER w) / CASE WHEN stddev_pop({c}) OVER w > 1e-12 THEN stddev_pop({c}) OVER w ELSE 1 END AS z{i}" for i, c in enumerate(CORE))} FROM rel r WHERE not_offered = 0 WINDOW w AS (PARTITION BY card_a))""",
        f"""big AS (SELECT card_a, count(*) FILTER (not_offered = 0) / count(*)::DOUBLE AS share, {", ".join(f"avg({c}) FILTER (not_offered = 0) AS m{i}, stddev_pop({c}) FILTER (not_offered = 0) AS d{i}" for i, c in enumerate(CORE))} FROM rel GROUP BY card_a HAVING count(*) FILTER ("T" = 1) >= 5 AND count(*) FILTER ("T" = 0 AND not_offered = 0) >= 5)""",
        f"w0 AS (SELECT card_a, [{', '.join(['0.0::DOUBLE'] * k)}] AS w FROM big)",
    ]
    for s in range(steps):
        eta = " + ".join(f"w[{i + 1}] * {x}" for i, x in enumerate(z))
        ridge = [1.0] * (k - 1) + [1e-9]
        rows = ", ".join(
            "[" + ", ".join([*(f"0.35 * sum(p * (1 - p) * {z[i]} * {z[j]})" + (f" + {ridge[i]}" if i == j else "") for j in range(k)), f"0.35 * sum((t - p) * {z[i]}) - {ridge[i]} * any_value(w[{i + 1}])"]) + "]" for i in range(k)
        )
        parts.append(f"e{s}_0 AS MATERIALIZED (SELECT card_a, any_value(w) AS w, [{rows}] AS m FROM (SELECT *, 1 / (1 + exp(-({eta}))) AS p FROM ofr JOIN w{s} USING (card_a)) GROUP BY card_a)")
        for j in range(1, k + 1):
            pivot = f"list_transform(m[{j}], lambda x: x / m[{j}][{j}])"
            parts.append(f"e{s}_{j} AS MATERIALIZED (SELECT card_a, w, list_transform(m, lambda r, i: CASE WHEN i = {j} THEN pv ELSE list_transform(list_zip(r, pv), lambda q: q[1] - r[{j}] * q[2]) END) AS m FROM (SELECT card_a, w, m, {pivot} AS pv FROM e{s}_{j - 1}))")
        parts.append(f"w{s + 1} AS MATERIALIZED (SELECT card_a, list_transform(w, lambda x, i: x + m[i][{k + 1}]) AS w FROM e{s}_{k})")
    eta = " + ".join([*(f"w[{i + 1}] * ({c} - m{i}) / CASE WHEN d{i} > 1e-12 THEN d{i} ELSE 1 END" for i, c in enumerate(CORE)), f"w[{k}]"])
    parts.append(f'sco AS MATERIALIZED (SELECT r.card_a, r.draft_id, "T" AS t, share / (1 + exp(-({eta}))) AS e FROM rel r JOIN w{steps} USING (card_a) JOIN big USING (card_a))')
    return ", ".join(parts)


_PAIRS = "SELECT cards.card AS card_a, groups.group_b, value FROM cards CROSS JOIN groups LEFT JOIN e ON e.card_a = cards.card AND e.group_b = groups.group_b WHERE cards.card IN (SELECT card_a FROM units)"

_WEIGHTED = f"""WITH {FRAME}, {_newton()}, o AS (SELECT card_a, draft_id, t, least(e, 0.999) / (1 - least(e, 0.999)) AS o FROM sco),
n AS (SELECT card_a, count(*) FILTER (t = 1) AS n1, sum(o) FILTER (t = 0) AS o0 FROM o GROUP BY card_a),
y AS (SELECT card_a, ycnt.group_b, sum(y) FILTER (t = 1) AS y1, sum(y * o) FILTER (t = 0) AS y0 FROM o JOIN ycnt USING (draft_id) GROUP BY ALL),
e AS (SELECT card_a, group_b, round(coalesce(y1, 0) / n1 - coalesce(y0, 0) / o0, 6) + 0.0 AS value FROM y JOIN n USING (card_a))
{_PAIRS}"""

_MATCHED = f"""WITH {FRAME}, {_newton()}, s AS (SELECT card_a, draft_id, t, round(e * 1e7)::BIGINT AS e FROM sco),
d AS (SELECT a.card_a, a.draft_id AS ti, b.draft_id AS ci, row_number() OVER (PARTITION BY a.card_a, a.draft_id ORDER BY abs(a.e - b.e), b.draft_id) AS r FROM s a JOIN s b ON a.card_a = b.card_a AND a.t = 1 AND b.t = 0),
n AS (SELECT card_a, ti, group_b, avg(y) AS y0 FROM d JOIN ycnt ON draft_id = ci WHERE r <= 3 GROUP BY ALL),
e AS (SELECT card_a, n.group_b, round(avg(y - y0), 6) + 0.0 AS value FROM n JOIN ycnt ON draft_id = ti AND ycnt.group_b = n.group_b GROUP BY ALL)
{_PAIRS}"""



def _double_learning(folds: int = 5, alpha: float = 1.0) -> str:
    """Ridge fits on the rows outside each fold by Gaussian elimination, residuals row by row, and their products."""
    k, groups = len(CORE) + 1, COLORS
    x, y = ["1.0", *(f"x{i}" for i in range(k - 1))], ["t", *(f"y{j}" for j in range(len(groups)))]
    rows = ", ".join("[" + ", ".join([*(f"sum({x[i]} * {x[j]})" + (f" + {alpha}" if i == j and i else "") for j in range(k)), *(f"sum({x[i]} * {c})" for c in y)]) + "]" for i in range(k))
    parts = [
        f"""base AS MATERIALIZED (SELECT card_a, r.draft_id, "T"::DOUBLE AS t, ('0x' || substring(md5('42:' || r.draft_id), 1, 8))::BIGINT % {folds} AS fold, {", ".join(f"{c}::DOUBLE AS x{i}" for i, c in enumerate(CORE))}, {", ".join(f"coalesce(w.y{j}, 0)::DOUBLE AS y{j}" for j in range(len(groups)))}
FROM rel r LEFT JOIN (SELECT draft_id, {", ".join(f"sum(y) FILTER (group_b = '{g}') AS y{j}" for j, g in enumerate(groups))} FROM ycnt GROUP BY draft_id) w ON w.draft_id = r.draft_id)""",
        f"g0 AS MATERIALIZED (SELECT card_a, k, [{rows}] AS m FROM base JOIN (SELECT range AS k FROM range({folds})) ON fold <> k GROUP BY card_a, k)",
    ]
    for j in range(1, k + 1):
        pivot = f"list_transform(m[{j}], lambda x: x / m[{j}][{j}])"
        parts.append(f"g{j} AS MATERIALIZED (SELECT card_a, k, list_transform(m, lambda r, i: CASE WHEN i = {j} THEN pv ELSE list_transform(list_zip(r, pv), lambda q: q[1] - r[{j}] * q[2]) END) AS m FROM (SELECT card_a, k, m, {pivot} AS pv FROM g{j - 1}))")
    rest = [f"{c} - ({' + '.join(f'm[{i + 1}][{k + 1 + n}] * {v}' for i, v in enumerate(x))}) AS r{n}" for n, c in enumerate(y)]
    parts.append(f"rest AS MATERIALIZED (SELECT b.card_a, t, {', '.join(rest)} FROM base b JOIN g{k} g ON g.card_a = b.card_a AND g.k = b.fold)")
    parts.append("e AS (" + " UNION ALL ".join(f"SELECT card_a, '{g}' AS group_b, round(sum(r{j + 1} * r0) / sum(r0 * r0), 6) + 0.0 AS value FROM rest GROUP BY card_a HAVING sum(t) >= 5 AND count(*) - sum(t) >= 5" for j, g in enumerate(groups)) + ")")
    return f"WITH {FRAME}, {', '.join(parts)} {_PAIRS}"


SQL: dict[str, str] = {
    "reference_effects": f"WITH {EFFECTS} SELECT card_a, group_b, 1::BIGINT AS pack, {q('itt_y', 'itt_d', 'late', 'se_late', 'z_stat', 'p_value')}, n_valid, n_invalid, n_incomplete, n_no_outcome, n_offered, n_treated, horizon_total, horizon_mean, horizon_min, horizon_max FROM effects JOIN acc USING (card_a)",
    "iv_sufficient_stats": f"WITH {STATS} SELECT card_a, group_b, z::BIGINT AS z, n, sum_d, sum_y, sum_y_sq, sum_dy FROM stats",
    "pick_stats": f"WITH {STATS_BY_CARD} SELECT * FROM card_stats",
    "unknown_picks": f"WITH {FACTS} SELECT card, sum(CASE WHEN pick_no = 0 THEN 2 ELSE 1 END)::BIGINT AS n FROM picks JOIN cards USING (card) WHERE no % 6 = 0 GROUP BY card",
    "treatment_selector": f"WITH {STATS_BY_CARD} SELECT card_name, p2p1_offered, p2p1_picked FROM card_stats WHERE p2p1_picked > 10 AND p2p1_offered < 9.5 * p2p1_picked",
    "slot_selector": f"WITH {STATS_BY_CARD} SELECT card_name AS card_a, round(p2p1_picked / p2p1_offered::DOUBLE, 6) AS pick_rate, g.group_b FROM card_stats JOIN cards ON card = card_name CROSS JOIN groups g WHERE rare = 1 AND p2p1_picked > 10 AND p2p1_picked / nullif(p2p1_offered, 0)::DOUBLE < 0.3",
    "pack_length_hist": f"WITH {FACTS}, h AS (SELECT p0, p1, p2, count(*) AS n_drafts FROM drafts GROUP BY ALL) SELECT p0 || ',' || p1 || ',' || p2 AS lengths, n_drafts, NOT (p0 = p1 AND p1 = p2) AS uneven, round(n_drafts / (SELECT sum(n_drafts) FROM h)::DOUBLE, 6) AS share FROM h",
    "draft_completeness": f"WITH {FACTS} SELECT draft_id, p0, p1, p2, mx, reached, (p0 = mx AND p1 = mx AND p2 = mx) AS complete FROM drafts",
    "incomplete_rate": f"WITH {FACTS}, r AS (SELECT count(*) AS n_drafts, count(*) FILTER (NOT (p0 = mx AND p1 = mx AND p2 = mx)) AS n_incomplete FROM drafts WHERE reached) SELECT n_drafts, n_incomplete, round(coalesce(n_incomplete / nullif(n_drafts, 0)::DOUBLE, 0.0), 6) AS rate, coalesce(n_incomplete / nullif(n_drafts, 0)::DOUBLE, 0.0) > 0.05 AS alarm FROM r",
    "prior_holders": f"WITH {FACTS} SELECT draft_id, card FROM held JOIN valid USING (draft_id)",
    "draft_accounting": f"WITH {FACTS} {ACCOUNTING} SELECT * FROM acc",
    "outcome_counts": f"WITH {FACTS} SELECT draft_id, group_b, y FROM ycnt WHERE y > 0",
    "split_halves": f"WITH {FACTS} SELECT draft_id, ('0x' || substring(md5('{SPLIT_SEED}:' || draft_id), 1, 8))::BIGINT % 2 AS half FROM drafts",
    "history_features": f"WITH {HISTORY} SELECT * REPLACE (round(avg_cmc, 6) AS avg_cmc, num_colors::BIGINT AS num_colors, num_colors_committed::BIGINT AS num_colors_committed, pips_total::BIGINT AS pips_total) FROM hist2",
    "relative_covariates": f"WITH {FRAME} SELECT draft_id, card_a, {q('oncolor_pip_share', 'oncolor_pip_min_share', 'offcolor_pip_share', 'avg_cmc')}, n_oncolor_pips::BIGINT AS n_oncolor_pips, n_fix_oncolor::BIGINT AS n_fix_oncolor, num_colors_committed::BIGINT AS num_colors_committed, n_rares FROM rel",
    "estimation_frame": f"WITH {FRAME}, ys AS (SELECT draft_id, {_YS} FROM ycnt GROUP BY draft_id) SELECT draft_id, card_a, \"T\"::BIGINT AS \"T\", not_offered::BIGINT AS not_offered, horizon, ys.* EXCLUDE (draft_id), n_prior, n_lands, n_creatures, num_colors::BIGINT AS num_colors, {q('avg_cmc', 'oncolor_pip_share')} FROM rel JOIN ys USING (draft_id)",
    "balance_smd": f"WITH {BALANCE} SELECT card_a, group_b, n_z1, n_z0, n_valid, n_invalid, n_incomplete, n_offered, {q('mean_x_z1', 'mean_x_z0', 'var_x_z1', 'var_x_z0', 'sd_x_z1', 'sd_x_z0', 'mean_diff', 'pooled_sd', 'smd', 'abs_smd')} FROM bal",
    "diag_quantiles": f"WITH {BALANCE} SELECT round(quantile_cont(abs_smd, 0.5), 6) AS q50, round(quantile_cont(abs_smd, 0.95), 6) AS q95, round(quantile_cont(abs_smd, 0.99), 6) AS q99, count(abs_smd) AS n FROM bal",
    "card_quantiles": f"WITH {BALANCE}, per AS (SELECT card_a, avg(abs_smd) AS mean, median(abs_smd) AS median, quantile_cont(abs_smd, 0.95) AS q95, max(abs_smd) AS max, count(abs_smd) AS n FROM bal GROUP BY card_a) SELECT round(median(mean), 6) AS median_mean, round(median(median), 6) AS median_median, round(median(q95), 6) AS median_q95, round(median(max), 6) AS median_max, sum(n)::BIGINT AS n FROM per",
    "exact_match_exclusion": f"{_EXCLUSION} SELECT card_a, group_b, 8::BIGINT AS n_covariates, n_z1t0, n_matched, n_z0_pool, n_z0_used, n_buckets, {q('drop_ratio', 'mean_bucket', 'mean_y_z1', 'mean_y_z0', 'var_y_z1', 'var_y_z0', 'sd_y_z1', 'sd_y_z0', 'mean_diff', 'pooled_sd', 'smd', 'abs_smd')} FROM o",
    "exclusion_summary": f"{_EXCLUSION} SELECT count(*) AS n_pairs, round(avg((drop_ratio < 0.5)::INT), 6) + 0.0 AS share_kept, round(quantile_cont(abs_smd, 0.5), 6) + 0.0 AS q50, round(quantile_cont(abs_smd, 0.95), 6) + 0.0 AS q95 FROM o",
    "satt": f"WITH {SCORING} SELECT card_a, group_b, round(satt, 6) + 0.0 AS value FROM satts",
    "satt_offered": f"WITH {SCORING} SELECT card_a, group_b, round(satt_offered, 6) + 0.0 AS value FROM satts",
    "match_cov_k3": f"""WITH {FRAME}, sc AS (SELECT card_a, draft_id, "T" AS t, {", ".join(f"CASE WHEN stddev_pop({c}) OVER w > 1e-12 THEN ({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w ELSE 0 END AS z{i}" for i, c in enumerate(CORE))} FROM rel WINDOW w AS (PARTITION BY card_a)),
d AS (SELECT a.card_a, a.draft_id AS ti, b.draft_id AS ci, row_number() OVER (PARTITION BY a.card_a, a.draft_id ORDER BY round({" + ".join(f"(a.z{i} - b.z{i}) ** 2" for i in range(len(CORE)))}, 9), b.draft_id) AS r FROM sc a JOIN sc b ON a.card_a = b.card_a AND a.t = 1 AND b.t = 0),
n AS (SELECT card_a, ti, group_b, avg(y) AS y0 FROM d JOIN ycnt ON draft_id = ci WHERE r <= 3 GROUP BY ALL),
e AS (SELECT card_a, n.group_b, round(avg(y - y0), 6) + 0.0 AS value FROM n JOIN ycnt ON draft_id = ti AND ycnt.group_b = n.group_b GROUP BY ALL)
SELECT cards.card AS card_a, groups.group_b, value FROM cards CROSS JOIN groups LEFT JOIN e ON e.card_a = cards.card AND e.group_b = groups.group_b WHERE cards.card IN (SELECT card_a FROM units)""",
    "sipw_logit": _WEIGHTED,
    "match_ps_logit_k3": _MATCHED,
    "dml": _double_learning(),
    "null_baselines": f"WITH {EFFECTS} SELECT 'null_zero' AS method, card_a, group_b, 0.0::DOUBLE AS value FROM effects UNION ALL SELECT 'null_mean', card_a, group_b, round((SELECT avg(late) FROM effects), 6) + 0.0 FROM effects",
    "enrich_pairs": f"WITH {SCORING} SELECT method, card_a, group_b, {q('late', 'se_late', 'value')} FROM scoring",
    "samplewise_errors": f"WITH {SCORING}, ids AS (SELECT card_a, group_b, row_number() OVER (ORDER BY card_a, group_b) - 1 AS sample_id FROM effects) SELECT sample_id, method, round(d * d, 6) + 0.0 AS sq_err, round(abs(d), 6) + 0.0 AS abs_err, CASE WHEN hs = 1 THEN cv END::BIGINT AS covered FROM rows_ JOIN ids USING (card_a, group_b)",
    "method_scores": f"WITH {SCORING}, m AS (SELECT method, count(*) AS n_used, sum(hs)::BIGINT AS n_used_se, {scored()} FROM rows_ GROUP BY method) SELECT method, n_used, n_used_se, {q('rmse', 'mae', 'ccc', 'accuracy95')} FROM m",
    "bh_adjusted": f"WITH {EFFECTS}, r AS (SELECT card_a, group_b, p_value, row_number() OVER (ORDER BY p_value, card_a, group_b) AS r, count(*) OVER () AS n FROM effects) SELECT card_a, group_b, round(p_value, 6) + 0.0 AS p_value, round(least(1.0, min(p_value * n / r) OVER (ORDER BY r DESC)), 6) + 0.0 AS q FROM r",
    "bh_reject": f"WITH {EFFECTS}, r AS (SELECT card_a, group_b, p_value, row_number() OVER (PARTITION BY card_a ORDER BY p_value, group_b) AS r, count(*) OVER (PARTITION BY card_a) AS n FROM effects) SELECT card_a, group_b, round(p_value, 6) + 0.0 AS p_value, r <= coalesce(max(CASE WHEN p_value <= 0.3 * r / n THEN r END) OVER (PARTITION BY card_a), 0) AS reject FROM r",
    "bootstrap_intervals": intervals("card_a"),
    "row_bootstrap": intervals("card_a || '|' || group_b"),
    "significance_matrix": f"{MATRIX} SELECT method_a, method_b, metric, n_pairs, n_clusters, symbol, {q('p', 'q')} FROM matrix",
    "disagreement_filter": f"{MATRIX}, wide AS (SELECT method_a, method_b, n_pairs, n_clusters, {', '.join(f'max(symbol) FILTER (metric = {chr(39)}{m}{chr(39)}) AS {m}' for m in _ORIENT)} FROM matrix GROUP BY ALL) SELECT * FROM wide WHERE NOT (rmse <> '~' AND rmse = mae AND mae = ccc AND ccc = accuracy95)",
    "rank_separation": _RSC,
    "rank_separation_fdr": _RSC_FDR,
    "rsc_sensitivity": _SWEEP,
    "rank_spearman": f"""WITH {SCORING}, m AS (SELECT 'v' || (no % 2) AS variant, method, {scored()} FROM rows_ JOIN cards ON card = card_a GROUP BY ALL),
l AS ({" UNION ALL ".join(f"SELECT variant, method, '{m}' AS metric, round({m}, 9) AS x FROM m WHERE {m} IS NOT NULL" for m in _ORIENT)}),
r AS (SELECT *, rank() OVER (PARTITION BY metric, variant ORDER BY x) + (count(*) OVER (PARTITION BY metric, variant, x) - 1) / 2.0 AS rk FROM l)
SELECT a.metric, a.variant AS variant_a, b.variant AS variant_b, round(covar_pop(a.rk, b.rk) / nullif(stddev_pop(a.rk) * stddev_pop(b.rk), 0), 6) + 0.0 AS rho FROM r a JOIN r b ON a.metric = b.metric AND a.method = b.method AND a.variant < b.variant GROUP BY ALL""",
    "value_per_quanta": f"WITH {EFFECTS}, e AS (SELECT quantile_cont(se_late, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q FROM effects), b AS (SELECT abs(late) AS size, se_late, CASE {' '.join(f'WHEN se_late < q[{i + 2}] THEN {i}' for i in range(4))} END AS bin FROM effects, e) SELECT bin::BIGINT AS bin, count(*) AS n, round(avg(se_late), 6) AS mean_x, round(avg(size), 6) AS mean_y, round(stddev_samp(size) / sqrt(count(*)), 6) AS sem_y FROM b WHERE bin IS NOT NULL GROUP BY bin",
    "set_summary": f"WITH {EFFECTS}, s AS (SELECT CASE WHEN no % 2 = 0 THEN 'EVN' ELSE 'ODD' END AS set_code, card_a, e.group_b FROM effects e JOIN cards ON card = card_a) SELECT set_code, count(*) AS n_pairs, count(DISTINCT card_a) AS n_cards, count(DISTINCT group_b) AS n_groups FROM s GROUP BY set_code UNION ALL SELECT 'All', count(*), count(DISTINCT card_a), count(DISTINCT group_b) FROM s",
    "group_labels": f"{_part_cards()} SELECT name, CASE WHEN len(coalesce(colors, face, []::VARCHAR[])) > 0 THEN array_to_string(coalesce(colors, face), '') ELSE 'C' END || '_' || CASE {' '.join(f'WHEN contains(type_line, {chr(39)}{t}{chr(39)}) THEN {chr(39)}{t}{chr(39)}' for t in ('Creature', 'Instant', 'Sorcery', 'Artifact', 'Enchantment', 'Land', 'Planeswalker'))} ELSE 'Other' END AS label FROM sym",
    "mana_pips": f"{_part_cards()} SELECT name, {', '.join(f'len(list_filter(flatten(list_transform(s, lambda x: string_split(x, {chr(39)}/{chr(39)}))), lambda x: x = {chr(39)}{c}{chr(39)}))::BIGINT AS pips_{c.lower()}' for c in COLORS)}, array_to_string(s, ' ') AS symbols FROM sym",
    "mana_value": f"{_part_cards()}, mv AS (SELECT *, coalesce(cmc, list_sum(list_transform(s, lambda x: coalesce(list_filter(list_transform(string_split(x, '/'), lambda y: try_cast(y AS DOUBLE)), lambda y: y IS NOT NULL)[1], CASE WHEN x = 'X' THEN 0.0 ELSE 1.0 END))), 0.0) AS mv FROM sym) SELECT name, round(mv, 6) AS mv, CASE WHEN mv BETWEEN 0 AND 1 THEN 'n_mv1' WHEN mv = 2 THEN 'n_mv2' WHEN mv = 3 THEN 'n_mv3' WHEN mv = 4 THEN 'n_mv4' WHEN mv = 5 THEN 'n_mv5' WHEN mv BETWEEN 6 AND 99 THEN 'n_mv6plus' END AS bucket, coalesce(rarity IN ('rare', 'mythic'), false) AS premium, contains(type_line, 'Land') AS land FROM mv",
    "grid_decode": "SELECT p_partkey, p_partkey % 24 AS point, [50, 100, 200][(p_partkey % 24 // 8 % 3) + 1]::BIGINT AS trees, [5, 10, 20, 40][(p_partkey % 24 // 2 % 4) + 1]::BIGINT AS rate, [3, 5][(p_partkey % 24 % 2) + 1]::BIGINT AS depth FROM part",
    "split_in_order": _sequence(),
}

SQL["page_chain_cards"] = "SELECT p_name AS name, arg_max(p_partkey, (p_size % 2) * 1000000000000 + p_partkey) AS p_partkey FROM part GROUP BY p_name"

#: A merged state gives what one pass gives.
SQL["merged_effects"] = SQL["reference_effects"]
