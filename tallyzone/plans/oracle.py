"""Independent SQL (DuckDB dialect) for every registered query.

Written from the semantics, not from the Spark plans: the k-NN vote is a
brute-force cross join with a window top-k, ranks are plain
``row_number()`` windows, centroids use ``lead()``, rows are repaired
before they are summed. Literals use exponents so that both engines type
them DOUBLE; 2-decimal rounding is half-to-even on the scaled double.
"""

from __future__ import annotations

from tallyzone.plans.catalog import DEMO_AS_OF, DEMO_EARLIEST, DEMO_LAYER_SCOPE, DEMO_PERIOD, \
    DEMO_PREFIX, DEMO_REQUESTS, DEMO_SCOPE, DEMO_VISIT, DEMO_ZIP, EMPTY_PERIOD, STRESS_K

RAW = """
raw AS (
  SELECT
    CAST(o_orderkey AS BIGINT) AS id,
    CAST(year(o_orderdate) AS INT) AS year,
    CAST(month(o_orderdate) AS INT) AS month,
    CASE WHEN o_orderkey % 211 = 0 THEN 'N/A'
         WHEN o_orderkey % 13 = 0 THEN NULL
         WHEN o_orderkey % 199 = 0 THEN concat(CAST(10001 + o_custkey % 180 AS VARCHAR), '.0')
         ELSE CAST(10001 + o_custkey % 180 AS VARCHAR) END AS zip_code,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL
         WHEN o_orderkey % 53 = 0 THEN 'Queens'
         WHEN (o_custkey % 180) % 15 < 2 THEN 'Staten Island'
         WHEN (o_custkey % 180) % 15 < 6 THEN 'Brooklyn'
         WHEN (o_custkey % 180) % 15 < 10 THEN 'Queens'
         WHEN (o_custkey % 180) % 15 < 13 THEN 'Manhattan'
         ELSE 'Bronx' END AS borough,
    CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST(1 + o_orderkey % 3 AS INT) END AS crash_count,
    CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 101 = 0 OR o_custkey % 180 = 179 THEN NULL
         WHEN o_orderkey % 103 = 0 THEN CAST('NaN' AS DOUBLE)
         ELSE 4.05e1 + 3e-2 * floor((o_custkey % 180) / 15) + 4e-5 * ((o_orderkey * 7919) % 1000) END AS latitude,
    CASE WHEN o_orderkey % 11 = 0 OR o_custkey % 180 = 179 THEN NULL
         WHEN o_orderkey % 103 = 0 THEN CAST('NaN' AS DOUBLE)
         ELSE -7.425e1 + 3.5e-2 * ((o_custkey % 180) % 15) + 4.5e-5 * ((o_orderkey * 6007) % 1000) END AS longitude
  FROM orders
)"""

TYPED = r"""
typed AS (
  SELECT id, year, month,
    CASE WHEN regexp_full_match(zip_code, '\s*[+-]?[0-9]+([.]0*)?\s*')
         THEN TRY_CAST(regexp_extract(zip_code, '[+-]?[0-9]+', 0) AS INTEGER) END AS zip_code,
    CAST(borough AS VARCHAR) AS borough,
    crash_count,
    CAST(CASE WHEN isnan(latitude) THEN NULL ELSE latitude END AS FLOAT) AS latitude,
    CAST(CASE WHEN isnan(longitude) THEN NULL ELSE longitude END AS FLOAT) AS longitude
  FROM raw
)"""

CLS = """
cls AS (
  SELECT *,
    CASE WHEN (latitude IS NULL) <> (longitude IS NULL) THEN 'partial_coords'
         WHEN zip_code IS NOT NULL AND latitude IS NOT NULL AND borough IS NOT NULL THEN 'zip_coords_borough'
         WHEN zip_code IS NOT NULL AND latitude IS NOT NULL THEN 'zip_coords'
         WHEN zip_code IS NOT NULL AND borough IS NOT NULL THEN 'zip_borough'
         WHEN zip_code IS NOT NULL THEN 'zip_only'
         WHEN latitude IS NOT NULL AND borough IS NOT NULL THEN 'coords_borough'
         WHEN latitude IS NOT NULL THEN 'coords_only'
         WHEN borough IS NOT NULL THEN 'borough_only'
         ELSE 'nothing' END AS cls
  FROM typed
)"""

KNN = """
train AS (
  SELECT id AS tid, CAST(latitude AS DOUBLE) AS tlat, CAST(longitude AS DOUBLE) AS tlon, zip_code AS tzip
  FROM cls WHERE cls = 'zip_coords_borough'
),
qry AS (
  SELECT id AS qid, CAST(latitude AS DOUBLE) AS qlat, CAST(longitude AS DOUBLE) AS qlon
  FROM cls WHERE cls IN ('coords_borough', 'coords_only')
),
nn AS (
  SELECT qid, tid, tzip, d2, row_number() OVER (PARTITION BY qid ORDER BY d2, tid) AS j
  FROM (SELECT qid, tid, tzip, (qlat - tlat) * (qlat - tlat) + (qlon - tlon) * (qlon - tlon) AS d2
        FROM qry CROSS JOIN train)
  QUALIFY j <= 5
),
vote AS (
  SELECT qid, tzip AS zip_code FROM (
    SELECT qid, tzip, row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, tzip) AS r
    FROM nn GROUP BY qid, tzip)
  WHERE r = 1
)"""

REPAIR = """
zcounts AS (
  SELECT zip_code, borough, count(*) AS n_records
  FROM cls WHERE cls = 'zip_coords_borough' GROUP BY zip_code, borough
),
zmap AS (
  SELECT zip_code, borough FROM (
    SELECT zip_code, borough, row_number() OVER (PARTITION BY zip_code ORDER BY n_records DESC, borough) AS r
    FROM zcounts)
  WHERE r = 1
),
filled AS (
  SELECT id, zip_code, borough, crash_count, latitude, longitude, cls
  FROM cls WHERE cls IN ('zip_coords_borough', 'zip_coords', 'zip_borough', 'zip_only')
  UNION ALL
  SELECT c.id, v.zip_code, c.borough, c.crash_count, c.latitude, c.longitude, c.cls
  FROM cls c LEFT JOIN vote v ON c.id = v.qid
  WHERE c.cls IN ('coords_borough', 'coords_only')
),
repaired AS (
  SELECT f.id, f.zip_code, m.borough, f.crash_count, f.latitude, f.longitude, f.cls
  FROM filled f LEFT JOIN zmap m ON f.zip_code = m.zip_code
),
agg AS (
  SELECT zip_code, CASE WHEN borough = 'Bronx' THEN 'The Bronx' ELSE borough END AS borough,
         CAST(coalesce(sum(crash_count), 0) AS BIGINT) AS total_crashes
  FROM repaired WHERE zip_code IS NOT NULL AND borough IS NOT NULL
  GROUP BY zip_code, borough
)"""

RANK = """
scoped AS (
  SELECT 'Citywide' AS scope, zip_code, borough, total_crashes FROM agg
  UNION ALL
  SELECT borough AS scope, zip_code, borough, total_crashes FROM agg
),
ranked0 AS (
  SELECT scope, zip_code, borough, total_crashes,
    CAST(row_number() OVER (PARTITION BY scope ORDER BY total_crashes DESC, zip_code) AS INTEGER) AS rank,
    count(*) OVER (PARTITION BY scope) AS n_areas,
    CAST(sum(total_crashes) OVER (PARTITION BY scope) AS BIGINT) AS scope_total
  FROM scoped
),
ranked1 AS (
  SELECT *, round_even(CAST(scope_total AS DOUBLE) / n_areas * 100, 0) / 100 AS scope_average
  FROM ranked0
),
edges10 AS (
  SELECT n, CASE WHEN v - floor(v) >= 5e-1 THEN (floor(v) + 2) - (1e0 - (v - floor(v)))
                 ELSE (floor(v) + 1) + (v - floor(v)) END AS edge
  FROM (SELECT n_areas AS n, (i * 1e-1 * 1e2 / 1e2) * (n_areas - 1) AS v
        FROM (SELECT DISTINCT n_areas FROM ranked1), (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8, 9]) AS i))
),
ranked AS (
  SELECT scope, zip_code, borough, total_crashes, rank,
    CASE WHEN scope_average = 0 THEN NULL
         ELSE round_even(total_crashes / scope_average * 100, 0) / 100 END AS crash_likelihood,
    CAST(1 + (SELECT count(*) FROM edges10 e WHERE e.n = n_areas AND rank > e.edge) AS INTEGER) AS decile,
    n_areas, scope_total, scope_average
  FROM ranked1
),
city AS (
  SELECT zip_code, borough, total_crashes, rank, crash_likelihood, decile
  FROM ranked WHERE scope = 'Citywide'
)"""

LAYER = """
cells AS (
  SELECT c, c % 15 AS col, floor(c / 15) % 1000 AS row,
    CASE WHEN c % 15 = 3 THEN concat(' ', CAST(10001 + c AS VARCHAR), ' ')
         ELSE CAST(10001 + c AS VARCHAR) END AS modzcta
  FROM (SELECT DISTINCT c_custkey - 1 AS c FROM customer)
),
rings AS (
  SELECT modzcta, 0 AS part, 0 AS ring, FALSE AS cw,
         -7.425e1 + 3.5e-2 * col AS x0, 4.05e1 + 3e-2 * row AS y0,
         -7.425e1 + 3.5e-2 * col + 3.5e-2 AS x1, 4.05e1 + 3e-2 * row + 3e-2 AS y1
  FROM cells
  UNION ALL
  SELECT modzcta, 0, 1, TRUE,
         -7.425e1 + 3.5e-2 * col + 8.75e-3, 4.05e1 + 3e-2 * row + 7.5e-3,
         -7.425e1 + 3.5e-2 * col + 2.625e-2, 4.05e1 + 3e-2 * row + 2.25e-2
  FROM cells WHERE col = 7
  UNION ALL
  SELECT modzcta, 1, 0, FALSE,
         -7.425e1 + 3.5e-2 * col, 4.05e1 + 3e-2 * row - 1.5e-2,
         -7.425e1 + 3.5e-2 * col + 1.75e-2, 4.05e1 + 3e-2 * row
  FROM cells WHERE row = 5
),
layer AS (
  SELECT modzcta, part, ring, seq,
    CASE WHEN cw THEN (CASE WHEN seq IN (2, 3) THEN x1 ELSE x0 END)
         ELSE (CASE WHEN seq IN (1, 2) THEN x1 ELSE x0 END) END AS x,
    CASE WHEN cw THEN (CASE WHEN seq IN (1, 2) THEN y1 ELSE y0 END)
         ELSE (CASE WHEN seq IN (2, 3) THEN y1 ELSE y0 END) END AS y
  FROM (SELECT *, unnest([0, 1, 2, 3, 4]) AS seq FROM rings)
),
feats AS (SELECT DISTINCT trim(modzcta) AS zip_text FROM layer),
padded AS (
  SELECT *, CASE WHEN length(CAST(zip_code AS VARCHAR)) < 5 THEN lpad(CAST(zip_code AS VARCHAR), 5, '0')
                 ELSE CAST(zip_code AS VARCHAR) END AS zip_text
  FROM city
),
ljoin AS (
  SELECT f.zip_text, p.borough, p.total_crashes, p.rank, p.crash_likelihood, p.decile
  FROM feats f LEFT JOIN padded p ON f.zip_text = p.zip_text
),
edges AS (
  SELECT zip_text, part, ring, ox, oy, x - ox AS x, y - oy AS y, x2 - ox AS x2, y2 - oy AS y2
  FROM (SELECT trim(modzcta) AS zip_text, part, ring, x, y,
          first_value(x) OVER w AS ox, first_value(y) OVER w AS oy, lead(x) OVER w AS x2, lead(y) OVER w AS y2
        FROM layer WINDOW w AS (PARTITION BY modzcta, part, ring ORDER BY seq))
),
ringsum AS (
  SELECT zip_text, part, ring, min(ox) AS ox, min(oy) AS oy,
    sum(x * y2 - x2 * y) AS s,
    sum((x + x2) * (x * y2 - x2 * y)) AS sx,
    sum((y + y2) * (x * y2 - x2 * y)) AS sy
  FROM edges WHERE x2 IS NOT NULL GROUP BY zip_text, part, ring
),
centroid AS (
  SELECT zip_text,
    round_even(sum(a * (ox + sx / (s * 3e0))) / sum(a) * 1e9, 0) / 1e9 AS centroid_x,
    round_even(sum(a * (oy + sy / (s * 3e0))) / sum(a) * 1e9, 0) / 1e9 AS centroid_y
  FROM (SELECT *, (CASE WHEN ring = 0 THEN 1e0 ELSE -1e0 END) * abs(s) / 2e0 AS a FROM ringsum WHERE s <> 0)
  GROUP BY zip_text
),
ltable AS (
  SELECT j.zip_text, j.borough, j.total_crashes, j.rank, j.decile, c.centroid_x, c.centroid_y,
    'Zip Code: ' || j.zip_text || '<br>Accidents: ' || coalesce(CAST(j.total_crashes AS VARCHAR), 'nan')
      || '<br>Decile: ' || coalesce(CAST(j.decile AS VARCHAR), 'nan')
      || '<br>Rank: ' || coalesce(CAST(j.rank AS VARCHAR), 'nan') AS label,
    CAST(least(j.decile, 9) AS INTEGER) AS colour_bin
  FROM ljoin j LEFT JOIN centroid c ON j.zip_text = c.zip_text
)"""

MONTHS = """
months AS (SELECT year, month, count(*) AS n_records FROM raw GROUP BY year, month)"""

_CTES = [RAW, TYPED, CLS, KNN, REPAIR, RANK, LAYER, MONTHS]


def _q(select: str, period=None) -> str:
    """The query over all records, or over those of a period of (year, month) pairs."""
    ctes = ",".join(_CTES)
    if period is not None:
        (sy, sm), (ey, em) = period
        ctes = ctes.replace("  FROM orders\n", f"""  FROM orders
  WHERE year(o_orderdate) * 100 + month(o_orderdate) BETWEEN {sy * 100 + sm} AND {ey * 100 + em}
""")
    return "WITH " + ctes + "\n" + select


(_sy, _sm), (_ey, _em) = DEMO_PERIOD
_AS_OF = f"DATE '{DEMO_AS_OF}'"
_EARLY = f"make_date({DEMO_EARLIEST[0]}, {DEMO_EARLIEST[1]}, 1)"
_LATEST = f"date_trunc('month', {_AS_OF})"


def _in_range(y: str, m: str) -> str:
    return f"(make_date({y}, {m}, 1) >= {_EARLY} AND make_date({y}, {m}, 1) <= {_LATEST})"


ORACLE: dict[str, str] = {
    "period_scan": _q(f"""
SELECT id, year, month, zip_code, borough, crash_count, latitude, longitude FROM raw
WHERE year * 100 + month BETWEEN {_sy * 100 + _sm} AND {_ey * 100 + _em}"""),
    "assign_row_id": _q("""
SELECT id, year, month, row_number() OVER (ORDER BY year, month, id) - 1 AS row_id FROM raw"""),
    "typed_records": _q("SELECT id, year, month, zip_code, borough, crash_count, latitude, longitude FROM typed"),
    "class_counts": _q("SELECT cls, count(*) AS n_records FROM cls GROUP BY cls"),
    "class_trusted": _q("""
SELECT id, zip_code, borough, crash_count, latitude, longitude FROM cls WHERE cls = 'zip_coords_borough'"""),
    "fillable_records": _q("""
SELECT id, zip_code, borough, crash_count, latitude, longitude, cls FROM cls
WHERE cls NOT IN ('borough_only', 'nothing', 'partial_coords')"""),
    "null_counts": _q("SELECT id, zip_code, borough, cls FROM cls WHERE crash_count IS NULL"),
    "zip_borough_counts": _q("SELECT zip_code, borough, n_records FROM zcounts"),
    "zip_borough_map": _q("SELECT zip_code, borough FROM zmap"),
    "borough_rename": _q("""
SELECT zip_code, CASE WHEN borough = 'Bronx' THEN 'The Bronx' ELSE borough END AS borough FROM zmap"""),
    "borough_repair": _q("""
SELECT c.id, c.zip_code, m.borough FROM cls c LEFT JOIN zmap m ON c.zip_code = m.zip_code
WHERE c.cls IN ('zip_coords_borough', 'zip_coords', 'zip_borough', 'zip_only')"""),
    "knn_neighbors": _q("SELECT qid AS id, CAST(j AS INTEGER) AS j, tid, tzip AS zip_code, d2 FROM nn"),
    "knn_zip_vote": _q("SELECT qid AS id, zip_code FROM vote"),
    "repaired_records": _q("SELECT id, zip_code, borough, crash_count, latitude, longitude, cls FROM repaired"),
    "union_distinct": _q("SELECT DISTINCT id, zip_code, borough, crash_count, latitude, longitude, cls FROM repaired"),
    "crashes_by_zip": _q("SELECT zip_code, borough, total_crashes FROM agg"),
    "scope_filter": _q(f"SELECT zip_code, borough, total_crashes FROM agg WHERE borough = '{DEMO_SCOPE}'"),
    "scope_summary": _q("""
SELECT scope, max(scope_total) AS total_crashes, max(n_areas) AS n_areas,
       max(scope_average) AS average_crashes_per_zip
FROM ranked GROUP BY scope"""),
    "rank_citywide": _q("SELECT zip_code, total_crashes, rank FROM city"),
    "rank_by_borough": _q("SELECT scope, zip_code, total_crashes, rank FROM ranked WHERE scope <> 'Citywide'"),
    "crash_likelihood": _q("SELECT zip_code, crash_likelihood FROM city"),
    "deciles": _q("SELECT zip_code, rank, decile FROM city"),
    "area_report": _q("SELECT zip_code, borough, total_crashes, rank, crash_likelihood, decile FROM city"),
    "area_report_all": _q("""
SELECT scope, zip_code, borough, total_crashes, rank, crash_likelihood, decile FROM ranked"""),
    "decile_rollup": _q("""
SELECT scope, decile, CAST(sum(total_crashes) AS BIGINT) AS decile_crashes,
  CASE WHEN max(scope_total) = 0 THEN NULL
       ELSE round_even(CAST(sum(total_crashes) AS DOUBLE) / max(scope_total) * 100 * 100, 0) / 100 END AS share_pct
FROM ranked GROUP BY scope, decile"""),
    "display_columns": _q("""
SELECT zip_code AS "Zip Code", borough AS "Borough", total_crashes AS "Accident Count", rank AS "Rank",
       crash_likelihood AS "Accident Likelihood", decile AS "Decile" FROM city"""),
    "unique_zips": _q("SELECT DISTINCT zip_code FROM agg"),
    "zip_prefix": _q(f"SELECT DISTINCT zip_code FROM agg WHERE starts_with(CAST(zip_code AS VARCHAR), '{DEMO_PREFIX}')"),
    "area_lookup": _q(f"""
SELECT c.zip_code, c.borough, c.total_crashes AS accident_count,
  c.rank AS city_rank, CAST(c.n_areas AS INTEGER) AS city_highest_rank, c.decile AS city_decile,
  c.crash_likelihood AS city_likelihood,
  b.rank AS borough_rank, CAST(b.n_areas AS INTEGER) AS borough_highest_rank, b.decile AS borough_decile,
  b.crash_likelihood AS borough_likelihood
FROM ranked c JOIN ranked b ON c.zip_code = b.zip_code AND b.scope = b.borough
WHERE c.scope = 'Citywide' AND c.zip_code = TRY_CAST(trim('{DEMO_ZIP}') AS INTEGER)"""),
    "area_lookup_all": _q("""
SELECT c.zip_code, c.borough, c.total_crashes AS accident_count,
  c.rank AS city_rank, CAST(c.n_areas AS INTEGER) AS city_highest_rank, c.decile AS city_decile,
  c.crash_likelihood AS city_likelihood,
  b.rank AS borough_rank, CAST(b.n_areas AS INTEGER) AS borough_highest_rank, b.decile AS borough_decile,
  b.crash_likelihood AS borough_likelihood
FROM ranked c JOIN ranked b ON c.zip_code = b.zip_code AND b.scope = b.borough
WHERE c.scope = 'Citywide'"""),
    "zip_padding": _q("""
SELECT zip_code, CASE WHEN length(CAST(zip_code AS VARCHAR)) < 5 THEN lpad(CAST(zip_code AS VARCHAR), 5, '0')
                      ELSE CAST(zip_code AS VARCHAR) END AS zip_text FROM agg"""),
    "layer_semi": _q(f"""
SELECT zip_text FROM feats WHERE zip_text IN (SELECT zip_text FROM padded WHERE borough = '{DEMO_LAYER_SCOPE}')"""),
    "layer_join": _q("SELECT zip_text, borough, total_crashes, rank, crash_likelihood, decile FROM ljoin"),
    "layer_centroid": _q("SELECT zip_text, centroid_x, centroid_y FROM centroid"),
    "layer_labels": _q("SELECT zip_text, label FROM ltable"),
    "layer_table": _q("""
SELECT zip_text, borough, total_crashes, rank, decile, centroid_x, centroid_y, label, colour_bin FROM ltable"""),
    "aggregate_roundtrip": _q("SELECT zip_code, borough, total_crashes FROM agg"),
    "load_or_build": _q("SELECT zip_code, borough, total_crashes FROM agg"),
    "valid_years": _q(f"""
SELECT CAST(y.year AS INTEGER) AS year, coalesce(c.n, 0) AS n_records
FROM (SELECT unnest(generate_series(year({_AS_OF}), {DEMO_EARLIEST[0]}, -1)) AS year) y
LEFT JOIN (SELECT year, count(*) AS n FROM raw GROUP BY year) c ON y.year = c.year"""),
    "valid_periods": _q(f"""
SELECT year, month, CAST(year * 100 + month AS INTEGER) AS month_key,
  {_in_range('year', 'month')} AS in_range,
  make_date(year, month, 1) = {_LATEST} AS is_latest,
  n_records
FROM months"""),
    "period_validity": _q(f"""
SELECT id, sy, sm, ey, em,
  {_in_range('sy', 'sm')} AS start_ok,
  {_in_range('ey', 'em')} AS end_ok,
  make_date(sy, sm, 1) <= make_date(ey, em, 1) AS ordered,
  ({_in_range('sy', 'sm')} AND {_in_range('ey', 'em')} AND make_date(sy, sm, 1) <= make_date(ey, em, 1)) AS valid
FROM (
  SELECT id, CAST(year(s) AS INTEGER) AS sy, CAST(month(s) AS INTEGER) AS sm,
         CAST(year(e) AS INTEGER) AS ey, CAST(month(e) AS INTEGER) AS em
  FROM (SELECT o_orderkey AS id, date_trunc('month', CAST(o_orderdate AS DATE)) AS s,
               date_trunc('month', CAST(o_orderdate AS DATE))
                 + to_months(CAST(o_orderkey % 25 AS INTEGER) - 6) AS e
        FROM orders))"""),
    "default_period": _q("""
SELECT a.year, a.month, a.default_year, a.default_month, coalesce(h.n_records, 0) AS n_default_records
FROM (SELECT year, month,
        CAST(year(make_date(year, month, 1) - INTERVAL 1 MONTH) AS INTEGER) AS default_year,
        CAST(month(make_date(year, month, 1) - INTERVAL 1 MONTH) AS INTEGER) AS default_month
      FROM months) a
LEFT JOIN months h ON h.year = a.default_year AND h.month = a.default_month"""),
    "period_label": _q("""
SELECT year, month, monthname(make_date(year, month, 1)) || ' ' || CAST(year AS VARCHAR) AS label, n_records
FROM months"""),
}

_REPORT = "zip_code, borough, total_crashes, rank, crash_likelihood, decile"
_vy, _vm = int(DEMO_VISIT[:4]), int(DEMO_VISIT[5:7])
_VISIT = (_vy, _vm - 1) if _vm > 1 else (_vy - 1, 12)
_now = (int(DEMO_AS_OF[:4]), int(DEMO_AS_OF[5:7]))
_VALID = [(i, r) for i, r in enumerate(DEMO_REQUESTS) if DEMO_EARLIEST <= r[0] <= r[1] <= _now]

ORACLE |= {
    "knn_neighbors_search": f"""
WITH points AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label FROM embeddings)
SELECT q.vec_id AS id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY
         (q.x - t.x) * (q.x - t.x) + (q.y - t.y) * (q.y - t.y), t.vec_id) AS INTEGER) AS j,
       t.vec_id AS tid, t.label AS zip, (q.x - t.x) * (q.x - t.x) + (q.y - t.y) * (q.y - t.y) AS d2
FROM points q CROSS JOIN points t WHERE q.vec_id % 100 = 0
QUALIFY j <= {STRESS_K}""",
    "replaced_aggregate": _q("SELECT zip_code, borough, total_crashes FROM agg"),
    "stored_period_scan": ORACLE["period_scan"],
    "empty_period": _q("SELECT zip_code, borough, total_crashes FROM agg", EMPTY_PERIOD),
    "report_totals": _q("""
SELECT scope, max(scope_total) AS total_crashes, max(scope_average) AS average_crashes_per_zip
FROM ranked GROUP BY scope"""),
    "default_report": _q(f"SELECT {_REPORT} FROM city", (_VISIT, _VISIT)),
    "validated_request": " UNION ALL ".join(
        f"SELECT * FROM ({_q(f'SELECT {i} AS request, {_REPORT} FROM city', r)})" for i, r in _VALID),
    "stored_layer": _q("SELECT trim(modzcta) AS zip_text, part, ring, CAST(seq AS INTEGER) AS seq, x, y FROM layer"),
    "geojson_layer": _q("SELECT trim(modzcta) AS zip_text, part, ring, CAST(seq AS INTEGER) AS seq, x, y FROM layer"),
    "current_month": _q(f"""
SELECT year, month, n_records FROM months WHERE month = month({_AS_OF}) AND year <= year({_AS_OF})"""),
}
