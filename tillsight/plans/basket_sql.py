"""SQL twin of :mod:`tillsight.sources.basket` (DuckDB dialect).

Every oracle statement starts with ``WITH`` + :data:`BASKET_CTES` and then
names ``transactions``, ``transaction_lines``, ``products``, ``stores`` like
tables.  Written independently of the Spark code: scan gaps use a plain
window per basket, null rules are spelled out with ``COALESCE``/``CASE``.
"""

from tillsight.functions.scalar import CITY_CODES

BASKET_CTES = """
tx0 AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
         o_orderdate + to_seconds(CAST((8 + o_orderkey % 15) * 3600 + (o_orderkey * 37) % 3600 AS BIGINT)) AS ts_start
  FROM orders
),
nl0 AS (
  SELECT l_orderkey, COUNT(*) AS n FROM lineitem
  WHERE NOT (l_returnflag = 'R' AND l_suppkey % 5 = 0) GROUP BY l_orderkey
),
transactions AS (
  SELECT CAST(o_orderkey AS BIGINT) AS id,
         CAST(o_custkey % 25 AS INTEGER) AS store_id,
         CAST(o_orderkey % 4 AS INTEGER) AS cash_desk,
         ts_start AS transaction_start,
         ts_start + to_seconds(CAST(330 + o_orderkey % 270 AS BIGINT)) AS transaction_end,
         o_totalprice AS total_amount,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'CASH' ELSE 'CREDIT_CARD' END AS payment_medium,
         CASE WHEN o_orderkey % 13 = 0 THEN CAST(1 + (o_orderkey * 7) % 10 AS INTEGER) END AS customer_feedback,
         CASE o_orderstatus
           WHEN 'F' THEN CAST(ROUND(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.0001 AS DECIMAL(5,4)), 2) AS DOUBLE)
           WHEN 'O' THEN CAST(0.0 AS DOUBLE) END AS damage,
         CASE o_orderstatus WHEN 'F' THEN 'FRAUD' WHEN 'O' THEN 'NORMAL' ELSE 'UNKNOWN' END AS label,
         CAST(COALESCE(nl0.n, 0) AS BIGINT) AS n_lines
  FROM tx0 LEFT JOIN nl0 ON tx0.o_orderkey = nl0.l_orderkey
),
transaction_lines AS (
  SELECT CAST(l_linenumber AS INTEGER) AS id,
         CAST(l_orderkey AS BIGINT) AS transaction_id,
         CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE CAST(l_partkey AS BIGINT) END AS product_id,
         tx0.ts_start + to_seconds(CAST((l_partkey * 31 + l_linenumber * 7) % 300 AS BIGINT)) AS "timestamp",
         CAST(l_quantity AS DOUBLE) AS pieces_or_weight,
         CASE WHEN l_returnflag = 'R' AND l_suppkey % 10 = 0 THEN CAST(0.0 AS DOUBLE)
              WHEN l_partkey % 10 = 3 THEN CAST(ROUND(CAST(p_retailprice AS DECIMAL(18,2)) * CAST(l_quantity AS DECIMAL(18,2)) * CAST(0.7 AS DECIMAL(2,1)), 2) AS DOUBLE)
              ELSE CAST(ROUND(CAST(p_retailprice AS DECIMAL(18,2)) * CAST(l_quantity AS DECIMAL(18,2)), 2) AS DOUBLE) END AS sales_price,
         (l_returnflag = 'R' AND l_suppkey % 5 = 0) AS was_voided,
         CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE (l_linestatus = 'O' OR l_partkey % 10 <> 0) END AS camera_product_similar,
         CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE ROUND(1.0 - 3 * l_discount, 2) END AS camera_certainty
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN tx0 ON l_orderkey = tx0.o_orderkey
),
products AS (
  SELECT CAST(p_partkey AS BIGINT) AS id, p_type AS category, CAST(p_retailprice AS DOUBLE) AS price,
         ROUND(p_size / 25.0, 4) AS popularity,
         (p_partkey % 4 = 0) AS sold_by_weight, (p_partkey % 9 = 0) AS age_restricted
  FROM part
),
stores AS (
  SELECT CAST(n_nationkey AS INTEGER) AS id, {city} AS location, r_name AS urbanization,
         CONCAT('1994-0', CAST(1 + n_nationkey % 9 AS VARCHAR), '-15') AS sco_introduction
  FROM nation JOIN region ON n_regionkey = r_regionkey
)
""".replace("{city}", "list_extract([" + ", ".join(f"'{c}'" for c in CITY_CODES) + f"], CAST(n_nationkey % {len(CITY_CODES)} AS INTEGER) + 1)")

# Category list of the driver's part table (p_type), sorted, plus MISSING.
CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD", "MISSING"]


def _cat_flag(c: str) -> str:
    return "has_" + c.lower()


# Per-basket aggregates over lines ⟕ products, written the straightforward way.
LINE_AGG_CTES = """
lp AS (
  SELECT l.transaction_id, l.product_id, l.was_voided, l.pieces_or_weight, l.sales_price,
         l.camera_product_similar, l.camera_certainty, l."timestamp",
         p.price, COALESCE(p.category, 'MISSING') AS category, p.popularity, p.sold_by_weight, p.age_restricted,
         (l.was_voided AND l.sales_price = 0 AND NOT l.camera_product_similar) AS unscanned
  FROM transaction_lines l LEFT JOIN products p ON l.product_id = p.id
),
gaps AS (
  SELECT transaction_id,
         date_diff('microsecond', LAG("timestamp") OVER (PARTITION BY transaction_id ORDER BY "timestamp"), "timestamp") AS gap_us,
         "timestamp"
  FROM transaction_lines
),
gap_agg AS (
  SELECT transaction_id,
         CASE WHEN COUNT("timestamp") > 1 THEN date_diff('microsecond', MIN("timestamp"), MAX("timestamp")) / (COUNT("timestamp") - 1) / 1e6 END AS mean_time_between_scans,
         MAX(gap_us) / 1e6 AS max_time_between_scans,
         MIN("timestamp") AS first_timestamp, MAX("timestamp") AS last_timestamp
  FROM gaps GROUP BY transaction_id
),
line_agg AS (
  SELECT transaction_id,
         BOOL_OR(was_voided) AS has_voided,
         CAST(COALESCE(SUM(CAST(was_voided AS BIGINT)), 0) AS BIGINT) AS n_voided,
         COALESCE(BOOL_OR(unscanned), FALSE) AS has_unscanned,
         CAST(COALESCE(SUM(CASE WHEN unscanned THEN price WHEN NOT unscanned THEN 0.0 END), 0) AS DOUBLE) AS price_unscanned_articles,
         CAST(COALESCE(SUM(CAST(age_restricted AS BIGINT)), 0) AS BIGINT) AS n_age_restricted,
         BOOL_OR(age_restricted) AS has_age_restricted,
         MAX(popularity) AS popularity_max, MIN(popularity) AS popularity_min,
         MAX(price) AS max_product_price,
         CAST(COALESCE(SUM(CAST(sold_by_weight AS BIGINT)), 0) AS BIGINT) AS n_sold_by_weight,
         BOOL_OR(sold_by_weight) AS has_sold_by_weight,
         NOT BOOL_AND(camera_product_similar) AS has_camera_detected_wrong_product,
         BOOL_OR(NOT camera_product_similar AND camera_certainty >= 0.8) AS has_camera_detected_wrong_product_high_certainty,
         CAST(COALESCE(SUM(price * pieces_or_weight - sales_price), 0) AS DOUBLE) AS calculated_price_difference,
         {cat_flags}
  FROM lp GROUP BY transaction_id
)
""".replace(
    "{cat_flags}",
    ",\n         ".join(f"BOOL_OR(category = '{c}') AS {_cat_flag(c)}" for c in CATEGORIES),
)


def _case_map(col: str, mapping: dict) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {col} {arms} END"


def _feature_ctes() -> str:
    cat_cols = ", ".join(f"la.{_cat_flag(c)}" for c in CATEGORIES)
    return f"""
fm0 AS (
  SELECT t.id AS transaction_id,
         CAST(t.store_id AS VARCHAR) AS store_id,
         CAST(t.cash_desk AS VARCHAR) AS cash_desk,
         t.total_amount, t.n_lines, t.payment_medium,
         t.customer_feedback IS NOT NULL AS has_feedback,
         CASE WHEN t.customer_feedback BETWEEN 1 AND 3 THEN 'LOW' WHEN t.customer_feedback BETWEEN 4 AND 6 THEN 'MIDDLE'
              WHEN t.customer_feedback BETWEEN 7 AND 9 THEN 'HIGH' WHEN t.customer_feedback = 10 THEN 'TOP'
              ELSE 'MISSING' END AS feedback_categorical,
         COALESCE(t.customer_feedback IN (1, 2, 3), FALSE) AS feedback_low,
         COALESCE(t.customer_feedback IN (4, 5, 6), FALSE) AS feedback_middle,
         COALESCE(t.customer_feedback IN (7, 8, 9), FALSE) AS feedback_high,
         COALESCE(t.customer_feedback = 10, FALSE) AS feedback_top,
         CASE WHEN hour(t.transaction_start) BETWEEN 8 AND 11 THEN 'morning'
              WHEN hour(t.transaction_start) BETWEEN 12 AND 15 THEN 'noon'
              WHEN hour(t.transaction_start) BETWEEN 16 AND 19 THEN 'afternoon'
              WHEN hour(t.transaction_start) BETWEEN 20 AND 22 THEN 'evening' END AS daytime,
         CAST(hour(t.transaction_start) AS INTEGER) AS hour,
         CAST(hour(t.transaction_start) AS VARCHAR) AS hour_categorical,
         dayname(t.transaction_start) AS day_of_week,
         monthname(t.transaction_start) AS month,
         CAST(trunc(date_diff('microsecond', t.transaction_start, t.transaction_end) / 1e6) AS BIGINT) AS transaction_duration_seconds,
         t.damage, t.label,
         {_case_map('s.location', CITY_CODES)} AS location,
         s.urbanization,
         la.has_voided, la.n_voided, la.has_unscanned, la.price_unscanned_articles, la.n_age_restricted,
         la.has_age_restricted, la.popularity_max, la.popularity_min, la.max_product_price, la.n_sold_by_weight,
         la.has_sold_by_weight, la.has_camera_detected_wrong_product, la.has_camera_detected_wrong_product_high_certainty,
         la.calculated_price_difference, {cat_cols},
         la.calculated_price_difference > 0.1 AS has_positive_price_difference,
         ga.mean_time_between_scans, ga.max_time_between_scans,
         date_diff('microsecond', t.transaction_start, ga.first_timestamp) / 1e6 AS time_to_first_scan,
         date_diff('microsecond', ga.last_timestamp, t.transaction_end) / 1e6 AS time_from_last_scan_to_end,
         CAST(trunc(date_diff('microsecond', strptime(s.sco_introduction, '%Y-%m-%d'), t.transaction_start) / 86400e6) AS BIGINT)
           AS days_since_sco_introduction
  FROM transactions t
  LEFT JOIN stores s ON t.store_id = s.id
  LEFT JOIN line_agg la ON la.transaction_id = t.id
  LEFT JOIN gap_agg ga ON ga.transaction_id = t.id
),
mode_cnt1 AS (
  SELECT label, has_camera_detected_wrong_product AS v, COUNT(*) AS c FROM fm0
  WHERE has_camera_detected_wrong_product IS NOT NULL GROUP BY 1, 2
),
mode_cnt2 AS (
  SELECT label, has_camera_detected_wrong_product_high_certainty AS v, COUNT(*) AS c FROM fm0
  WHERE has_camera_detected_wrong_product_high_certainty IS NOT NULL GROUP BY 1, 2
),
mode1 AS (SELECT label, v FROM (SELECT label, v, ROW_NUMBER() OVER (PARTITION BY label ORDER BY c DESC, v) AS rn FROM mode_cnt1) WHERE rn = 1),
mode2 AS (SELECT label, v FROM (SELECT label, v, ROW_NUMBER() OVER (PARTITION BY label ORDER BY c DESC, v) AS rn FROM mode_cnt2) WHERE rn = 1),
means AS (SELECT label, AVG(mean_time_between_scans) AS m1, AVG(max_time_between_scans) AS m2 FROM fm0 GROUP BY label),
fm AS (
  SELECT fm0.* REPLACE (
           COALESCE(fm0.has_camera_detected_wrong_product, mode1.v) AS has_camera_detected_wrong_product,
           COALESCE(fm0.has_camera_detected_wrong_product_high_certainty, mode2.v) AS has_camera_detected_wrong_product_high_certainty,
           COALESCE(fm0.mean_time_between_scans, means.m1) AS mean_time_between_scans,
           COALESCE(fm0.max_time_between_scans, means.m2) AS max_time_between_scans)
  FROM fm0
  LEFT JOIN mode1 ON fm0.label IS NOT DISTINCT FROM mode1.label
  LEFT JOIN mode2 ON fm0.label IS NOT DISTINCT FROM mode2.label
  LEFT JOIN means ON fm0.label IS NOT DISTINCT FROM means.label
)
"""


def feature_sql(body: str, extra_ctes: str = "") -> str:
    """WITH basket + line aggregates + feature matrix (fm0 raw, fm imputed) + extra CTEs."""
    ctes = BASKET_CTES + "," + LINE_AGG_CTES + "," + _feature_ctes()
    if extra_ctes:
        ctes += "," + extra_ctes
    return "WITH " + ctes + "\n" + body
