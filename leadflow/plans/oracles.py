"""DuckDB oracle SQL for the registered queries.

Written from the specification (the binding in FIXTURES.md and the operator
semantics), not from the Spark code: the bound views use DATE values
directly instead of rendering and re-parsing text, the dedups are plain
window functions, the similarity oracle enumerates pairs with a theta join.
Doubles are rounded to 4 dp unless the operator prescribes another scale.
"""

from __future__ import annotations

# ---------------------------------------------------------------- bound views

_LEAD_COLS = """
    CAST(o.o_custkey AS VARCHAR) AS cif,
    o.o_orderpriority AS nama_program,
    'Y' || CAST(year(o.o_orderdate) AS VARCHAR) AS jenis_leads,
    upper(substr(o.o_orderpriority, 3)) AS media_blasting,
    CAST(date_trunc('month', o.o_orderdate) AS DATE) AS periode_start,
    CASE WHEN month(o.o_orderdate) <= 6 THEN 'PROGRAM H1' ELSE 'PROGRAM H2' END AS flag_program,
    CAST(c.c_nationkey % 17 + 1 AS INTEGER) AS wilayah,
    CAST(o.o_orderkey % 340 AS INTEGER) AS cabang,
    CAST(o.o_orderkey % 100 AS INTEGER) AS outlet,
    CAST(NULL AS VARCHAR) AS segment_crs,
    upper(c.c_mktsegment) AS segment_by_aum,
    CAST(NULL AS VARCHAR) AS segment_wondr,
    o.o_orderstatus AS segment_div_owner,
    CASE WHEN c.c_acctbal < 0 THEN 'GEN ALPHA' WHEN c.c_acctbal < 2500 THEN 'GEN Z'
         WHEN c.c_acctbal < 5000 THEN 'GEN Y' WHEN c.c_acctbal < 7500 THEN 'GEN X'
         ELSE 'BABY BOOMER' END AS range_usia,
    CAST(c.c_acctbal AS DOUBLE) AS range_saldo_tab,
    CAST(NULL AS DOUBLE) AS avg_aum_3_bln,
    CAST(o.o_totalprice AS DOUBLE) AS potensi_money"""

LEAD_COLUMNS = ("cif, nama_program, jenis_leads, media_blasting, periode_start, flag_program, "
                "wilayah, cabang, outlet, segment_crs, segment_by_aum, segment_wondr, "
                "segment_div_owner, range_usia, range_saldo_tab, avg_aum_3_bln, potensi_money")

SLUG = ("regexp_replace(regexp_replace(nama_program || '_' || strftime(periode_start, '%Y-%m-%d'), "
        "'\\s+', '_', 'g'), '[^A-Za-z0-9_\\-]', '', 'g')")

BASE = f"""
WITH lr AS (
  SELECT {_LEAD_COLS}, o.o_orderkey AS src_key
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
),
leads AS (
  SELECT {LEAD_COLUMNS}, {SLUG} AS campaign_id,
         CAST(year(periode_start) AS INTEGER) AS year,
         CAST(month(periode_start) AS INTEGER) AS month
  FROM (SELECT *, row_number() OVER (PARTITION BY cif, nama_program, periode_start ORDER BY src_key) AS rn FROM lr) t
  WHERE rn = 1
),
mon_all AS (
  SELECT CAST(o.o_custkey AS VARCHAR) AS cif, o.o_orderpriority AS nama_program,
         CAST(date_trunc('month', o.o_orderdate) AS DATE) AS periode_start,
         CAST(date_trunc('month', o.o_orderdate) AS DATE) + CAST(l.l_partkey % 120 AS INTEGER) AS take_up_date,
         CAST(l.l_shipdate AS DATE) AS ship_date,
         CAST(l.l_extendedprice AS DOUBLE) AS total_transaction_value,
         o.o_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice,
         CAST(o.o_orderkey % 340 AS INTEGER) AS cabang, CAST(o.o_orderkey % 100 AS INTEGER) AS outlet,
         o.o_orderstatus AS segment_div_owner, o.o_totalprice AS potensi_money
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
                  JOIN customer c ON o.o_custkey = c.c_custkey
  WHERE l.l_returnflag = 'R'
),
mon AS (
  SELECT cif, nama_program, periode_start, take_up_date, total_transaction_value FROM (
    SELECT *, row_number() OVER (PARTITION BY cif, nama_program, periode_start ORDER BY take_up_date, o_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn
    FROM mon_all) t WHERE rn = 1
),
enriched AS (
  SELECT l.*, m.take_up_date, m.total_transaction_value,
         CASE WHEN m.cif IS NULL THEN 'NO' ELSE 'YES' END AS take_up_flag,
         CAST(date_diff('day', l.periode_start, m.take_up_date) AS INTEGER) AS time_to_take_up_days
  FROM leads l LEFT JOIN mon m
    ON l.cif = m.cif AND l.nama_program = m.nama_program AND l.periode_start = m.periode_start
),
master AS (
  SELECT campaign_id, nama_program, flag_program, jenis_leads, media_blasting, wilayah,
         periode_start, year, month,
         count(*) AS total_leads,
         CAST(sum(CASE WHEN take_up_flag = 'YES' THEN 1 ELSE 0 END) AS BIGINT) AS total_take_up,
         sum(total_transaction_value) AS total_transaction_value,
         avg(time_to_take_up_days) AS avg_time_to_take_up_days
  FROM enriched
  GROUP BY campaign_id, nama_program, flag_program, jenis_leads, media_blasting, wilayah,
           periode_start, year, month
),
catalogue AS (
  SELECT {SLUG} AS campaign_id, nama_program, periode_start AS start_date,
         CAST(date_diff('day', periode_start, CAST(periode_start + to_months([1, 2, 3, 4, 6][CAST(substr(nama_program, 1, 1) AS INTEGER)])
              - INTERVAL 1 DAY AS DATE)) AS INTEGER) AS duration_days,
         CAST(periode_start + to_months([1, 2, 3, 4, 6][CAST(substr(nama_program, 1, 1) AS INTEGER)])
              - INTERVAL 1 DAY AS DATE) AS end_date
  FROM (SELECT DISTINCT o_orderpriority AS nama_program,
               CAST(date_trunc('month', o_orderdate) AS DATE) AS periode_start FROM orders) t
),
dim AS (
  SELECT campaign_id, min(nama_program) AS nama_program, min(flag_program) AS flag_program,
         min(jenis_leads) AS jenis_leads, min(media_blasting) AS media_blasting,
         min(periode_start) AS periode_start,
         CAST(sum(total_leads) AS BIGINT) AS total_leads,
         CAST(sum(total_take_up) AS BIGINT) AS total_take_up,
         sum(total_transaction_value) AS total_transaction_value,
         CASE WHEN sum(total_leads) > 0
              THEN CAST(sum(total_take_up) AS DOUBLE) / CAST(sum(total_leads) AS DOUBLE) * 100.0
              ELSE 0.0 END AS take_up_rate
  FROM master GROUP BY campaign_id
),
camp AS (
  SELECT campaign_id, periode_start, duration_days, granularity,
         period_bucket,
         CASE WHEN granularity = 'weekly' THEN period_bucket + 6 ELSE last_day(period_bucket) END AS period_end
  FROM (
    SELECT *, CASE WHEN granularity = 'weekly' THEN CAST(date_trunc('week', periode_start) AS DATE)
                   ELSE CAST(date_trunc('month', periode_start) AS DATE) END AS period_bucket
    FROM (
      SELECT d.campaign_id, d.periode_start,
             CAST(coalesce(date_diff('day', c.start_date, c.end_date), 0) AS INTEGER) AS duration_days,
             CASE WHEN coalesce(date_diff('day', c.start_date, c.end_date), 0) <= 90
                  THEN 'weekly' ELSE 'monthly' END AS granularity
      FROM dim d LEFT JOIN catalogue c ON d.campaign_id = c.campaign_id) a) b
),
ov AS (
  SELECT c.period_bucket AS period_start, c.period_end, c.granularity,
         m.flag_program AS product, m.media_blasting AS channel,
         CAST(m.wilayah AS VARCHAR) AS region,
         CAST(sum(m.total_leads) AS BIGINT) AS total_leads,
         CAST(sum(m.total_take_up) AS BIGINT) AS total_take_up,
         sum(m.total_transaction_value) AS total_transaction_value,
         count(DISTINCT m.campaign_id) AS campaign_count
  FROM master m JOIN camp c ON m.campaign_id = c.campaign_id
  GROUP BY 1, 2, 3, 4, 5, 6
),
weekly AS (
  SELECT campaign_id, wilayah AS region, CAST(date_trunc('week', periode_start) AS DATE) AS week_start,
         count(*) AS leads_count,
         CAST(sum(CASE WHEN take_up_flag = 'YES' THEN 1 ELSE 0 END) AS BIGINT) AS take_up_count,
         CAST(avg(CAST(total_transaction_value AS DECIMAL(18, 2))) AS DOUBLE) AS avg_transaction_value
  FROM enriched GROUP BY 1, 2, 3
),
reg AS (
  SELECT campaign_id, wilayah, 'Wilayah ' || CAST(wilayah AS VARCHAR) AS region_name,
         count(*) AS total_leads,
         CAST(sum(CASE WHEN take_up_flag = 'YES' THEN 1 ELSE 0 END) AS BIGINT) AS total_take_up,
         sum(CASE WHEN take_up_flag = 'YES' THEN coalesce(CAST(total_transaction_value AS DECIMAL(18, 2)), 0) END) AS value_sum,
         min(flag_program) AS flag_program
  FROM enriched WHERE wilayah IS NOT NULL GROUP BY 1, 2
),
days AS (
  SELECT campaign_id, media_blasting, wilayah, time_to_take_up_days AS d
  FROM enriched
  WHERE take_up_flag = 'YES' AND take_up_date IS NOT NULL AND time_to_take_up_days IS NOT NULL
),
metrics AS (
  SELECT e.campaign_id, min(e.nama_program) AS campaign_name, min(e.flag_program) AS flag_program,
         count(*) AS total_leads,
         CAST(sum(CASE WHEN e.take_up_flag = 'YES' THEN 1 ELSE 0 END) AS BIGINT) AS total_take_up,
         sum(coalesce(e.total_transaction_value, 0.0)) AS value_sum
  FROM enriched e GROUP BY 1
),
pairs AS (
  SELECT a.campaign_id, b.campaign_id AS similar_campaign_id, b.nama_program AS campaign_name,
         coalesce(a.flag_program = b.flag_program, false) AS mf,
         coalesce(a.jenis_leads = b.jenis_leads, false) AS mj,
         coalesce(a.media_blasting = b.media_blasting, false) AS mm,
         b.take_up_rate, b.total_leads, b.total_take_up
  FROM dim a JOIN dim b ON a.campaign_id < b.campaign_id OR a.campaign_id > b.campaign_id
),
scored AS (
  SELECT *, CAST(CAST(mf AS INTEGER) + CAST(mj AS INTEGER) + CAST(mm AS INTEGER) AS INTEGER) AS dimension_count,
         concat_ws(',', CASE WHEN mf THEN 'flag_program' END, CASE WHEN mj THEN 'jenis_leads' END,
                   CASE WHEN mm THEN 'media_blasting' END) AS matching_dimensions
  FROM pairs
),
bd AS (
  SELECT campaign_id, 'segment_by_aum' AS breakdown, segment_by_aum AS label, count(*) AS leads,
         CAST(sum(CASE WHEN take_up_flag = 'YES' THEN 1 ELSE 0 END) AS BIGINT) AS take_up
  FROM enriched GROUP BY 1, 2, 3
  UNION ALL
  SELECT campaign_id, 'wilayah', CAST(wilayah AS VARCHAR), count(*),
         CAST(sum(CASE WHEN take_up_flag = 'YES' THEN 1 ELSE 0 END) AS BIGINT)
  FROM enriched GROUP BY 1, 2, 3
),
bdr AS (
  SELECT *, CASE WHEN leads > 0 THEN CAST(take_up AS DOUBLE) / CAST(leads AS DOUBLE) * 100.0 ELSE 0.0 END AS take_up_rate
  FROM bd
),
rates AS (
  SELECT campaign_id, count(*) AS total_leads,
         CAST(sum(CASE WHEN take_up_flag = 'YES' THEN 1 ELSE 0 END) AS BIGINT) AS total_take_up,
         round(avg(CASE WHEN take_up_flag = 'YES' THEN time_to_take_up_days END), 1) AS avg_days,
         min(media_blasting) AS media_blasting,
         round(CASE WHEN count(*) > 0 THEN CAST(sum(CASE WHEN take_up_flag = 'YES' THEN 1 ELSE 0 END) AS DOUBLE)
                    / CAST(count(*) AS DOUBLE) * 100.0 ELSE 0.0 END, 2) AS take_up_rate
  FROM enriched GROUP BY 1
),
seg_best AS (
  SELECT campaign_id, label AS best_segment, take_up_rate AS best_segment_rate FROM (
    SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY take_up_rate DESC, label) AS rn
    FROM bdr WHERE breakdown = 'segment_by_aum' AND leads > 0 AND take_up_rate > 0) t WHERE rn = 1
),
seg_worst AS (
  SELECT campaign_id, label AS worst_segment, take_up_rate AS worst_segment_rate FROM (
    SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY take_up_rate, label) AS rn
    FROM bdr WHERE breakdown = 'segment_by_aum' AND leads > 0 AND take_up_rate < 100) t WHERE rn = 1
),
seg_bw AS (
  SELECT c.campaign_id, b.best_segment, b.best_segment_rate, w.worst_segment, w.worst_segment_rate
  FROM (SELECT DISTINCT campaign_id FROM bdr WHERE breakdown = 'segment_by_aum' AND leads > 0) c
  LEFT JOIN seg_best b ON c.campaign_id = b.campaign_id
  LEFT JOIN seg_worst w ON c.campaign_id = w.campaign_id
),
reg2 AS (
  SELECT b.*, CAST(b.label AS INTEGER) AS w, r.take_up_rate AS camp_rate
  FROM bdr b JOIN rates r ON b.campaign_id = r.campaign_id
  WHERE b.breakdown = 'wilayah' AND b.leads >= 2
),
reg_bl AS (
  SELECT c.campaign_id, rb.best_region, rb.best_region_rate, coalesce(lw.low_regions, '') AS low_regions
  FROM (SELECT DISTINCT campaign_id FROM reg2) c
  LEFT JOIN (SELECT campaign_id, w AS best_region, take_up_rate AS best_region_rate FROM (
      SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY take_up_rate DESC, w) AS rn
      FROM reg2 WHERE take_up_rate > 0) t WHERE rn = 1) rb ON c.campaign_id = rb.campaign_id
  LEFT JOIN (SELECT campaign_id, string_agg(CAST(w AS VARCHAR), ',' ORDER BY w) AS low_regions
             FROM reg2 WHERE take_up_rate < camp_rate * 0.5 GROUP BY 1) lw ON c.campaign_id = lw.campaign_id
),
sim_best AS (
  SELECT campaign_id, similar_campaign_id AS best_similar_id, take_up_rate AS best_similar_rate,
         dimension_count / 3.0 AS best_similar_score, n AS similar_count FROM (
    SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY take_up_rate DESC, similar_campaign_id) AS rn,
           count(*) OVER (PARTITION BY campaign_id) AS n
    FROM scored WHERE dimension_count >= 1) t WHERE rn = 1
)
"""

RATE = "CASE WHEN {d} > 0 THEN CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE) * 100.0 ELSE 0.0 END"


def rate(n: str, d: str) -> str:
    return RATE.format(n=n, d=d)


# The CSV drop has no lineage column: keep-first falls back to all columns.
_LEAD_ORDER = "ORDER BY src_key) AS rn FROM lr"
_LEAD_ORDER_CSV = ("ORDER BY jenis_leads, media_blasting, flag_program, wilayah, cabang, outlet, "
                   "segment_crs, segment_by_aum, segment_wondr, segment_div_owner, range_usia, "
                   "range_saldo_tab, avg_aum_3_bln, potensi_money) AS rn FROM lr")
_MON_ORDER = "ORDER BY take_up_date, o_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn"
_MON_ORDER_CSV = "ORDER BY take_up_date, l_extendedprice) AS rn"


# the rows that the dirty CSV drop spoils: no number, no customer id, no date
_MISFIT = "o.o_orderstatus = 'P'"
_BLANK = "c.c_acctbal < -900"
_NO_DATE = "(o.o_orderpriority = '4-NOT SPECIFIED' AND c.c_nationkey % 17 + 1 = 17)"


def base(csv: bool = False, ship_date: bool = False, dirty: bool = False) -> str:
    b = BASE
    if dirty:
        good = f"NOT {_MISFIT} AND NOT {_BLANK} AND NOT {_NO_DATE}"
        b = b.replace("FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey\n),",
                      f"FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE {good}\n),")
        b = b.replace("WHERE l.l_returnflag = 'R'", f"WHERE l.l_returnflag = 'R' AND {good}")
    if csv:
        b = b.replace("ORDER BY src_key) AS rn FROM lr", _LEAD_ORDER_CSV)
        b = b.replace("ORDER BY take_up_date, o_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn",
                      _MON_ORDER_CSV)
    if ship_date:
        b = b.replace("CAST(date_trunc('month', o.o_orderdate) AS DATE) + CAST(l.l_partkey % 120 AS INTEGER) AS take_up_date",
                      "CAST(l.l_shipdate AS DATE) AS take_up_date")
    return b


def _q(body: str, **kw) -> str:
    return base(**kw) + body


ORACLES: dict[str, str] = {}

ORACLES["dedup_leads"] = _q(f"SELECT {LEAD_COLUMNS} FROM leads")
ORACLES["clean_leads"] = _q("SELECT * FROM leads")
ORACLES["enrich_leads"] = _q("""
SELECT * EXCLUDE (total_transaction_value), round(total_transaction_value, 4) AS total_transaction_value
FROM enriched""")
ORACLES["campaign_master"] = _q(f"""
SELECT campaign_id, nama_program, flag_program, jenis_leads, media_blasting, wilayah,
       periode_start, year, month, total_leads, total_take_up,
       round(total_transaction_value, 4) AS total_transaction_value,
       round(avg_time_to_take_up_days, 4) AS avg_time_to_take_up_days,
       round({rate('total_take_up', 'total_leads')}, 4) AS take_up_rate
FROM master""")


def sround(expr: str, scale: int) -> str:
    """Half-up rounding of a double's shortest decimal text, which is how
    Spark's ``round`` treats doubles (DuckDB's own ``round`` scales by a
    power of ten first and can tip a value like 101225.58499999999 up)."""
    return f"CAST(round(CAST(CAST(({expr}) AS VARCHAR) AS DECIMAL(38, 12)), {scale}) AS DOUBLE)"


def cents_avg(cents_sum: str, n: str) -> str:
    """Exact half-up average of a money sum, in integer cents."""
    c = f"CAST(({cents_sum}) * 100 AS HUGEINT)"
    return f"CAST(({c} * 2 + ({n})) // (2 * ({n})) AS DOUBLE) / 100.0"


def r4(c: str, alias: str | None = None) -> str:
    return f"{sround(c, 4)} AS {alias or c}"


ORACLES["campaign_dim"] = _q(f"""
SELECT campaign_id, nama_program, flag_program, jenis_leads, media_blasting, periode_start,
       total_leads, total_take_up, {r4('total_transaction_value')}, {r4('take_up_rate')}
FROM dim""")

ORACLES["granularity"] = _q("SELECT campaign_id, duration_days, granularity FROM camp")
ORACLES["period_buckets"] = _q("SELECT campaign_id, granularity, period_bucket, period_end FROM camp")

_OV = f"""period_start, period_end, granularity, product, channel, region, total_leads, total_take_up,
       round({rate('total_take_up', 'total_leads')}, 4) AS take_up_rate,
       {r4('total_transaction_value')}, campaign_count"""
ORACLES["overview_agg"] = _q(f"SELECT {_OV} FROM ov")
_OV_ORDER = "period_start, period_end, granularity, product, channel, region"
ORACLES["overview_query"] = _q(f"""
SELECT {_OV}, row_number() OVER (ORDER BY {_OV_ORDER}) AS position FROM ov
WHERE period_start >= DATE '1996-01-01' AND period_end <= DATE '1999-12-31'
  AND product IN ('PROGRAM H1') AND channel IN ('URGENT', 'HIGH', 'LOW')
  AND region IN ('1', '2', '3', '4', '5', '6', '7', '8', '9')""")
ORACLES["overview_totals"] = _q(f"""
SELECT count(*) AS total_leads,
       CAST(sum(CASE WHEN take_up_flag = 'YES' THEN 1 ELSE 0 END) AS BIGINT) AS total_take_up,
       count(DISTINCT campaign_id) AS total_campaigns,
       round(round({rate("sum(CASE WHEN take_up_flag = 'YES' THEN 1 ELSE 0 END)", 'count(*)')}, 2), 4) AS take_up_rate
FROM enriched""")
ORACLES["overview_totals_from_agg"] = _q(f"""
SELECT CAST(sum(total_leads) AS BIGINT) AS total_leads, CAST(sum(total_take_up) AS BIGINT) AS total_take_up,
       CAST(sum(campaign_count) AS BIGINT) AS campaign_group_count,
       (SELECT count(DISTINCT campaign_id) FROM master) AS total_campaigns,
       round({rate('sum(total_take_up)', 'sum(total_leads)')}, 2) AS take_up_rate
FROM ov""")
ORACLES["overview_totals_filtered"] = _q(f"""
, hit AS (
  SELECT m.* FROM master m JOIN camp c ON m.campaign_id = c.campaign_id
  WHERE c.period_bucket >= DATE '1996-01-01' AND c.period_end <= DATE '1999-12-31'
    AND m.flag_program = 'PROGRAM H1' AND m.media_blasting IN ('URGENT', 'HIGH', 'LOW') AND m.wilayah BETWEEN 1 AND 9)
SELECT CAST(sum(total_leads) AS BIGINT) AS total_leads, CAST(sum(total_take_up) AS BIGINT) AS total_take_up,
       (SELECT CAST(sum(campaign_count) AS BIGINT) FROM ov
        WHERE period_start >= DATE '1996-01-01' AND period_end <= DATE '1999-12-31' AND product = 'PROGRAM H1'
          AND channel IN ('URGENT', 'HIGH', 'LOW') AND region IN ('1', '2', '3', '4', '5', '6', '7', '8', '9')) AS campaign_group_count,
       count(DISTINCT campaign_id) AS total_campaigns,
       round({rate('sum(total_take_up)', 'sum(total_leads)')}, 2) AS take_up_rate
FROM hit""")
ORACLES["overview_by_channel"] = _q(f"""
SELECT flag_program AS product, media_blasting AS channel, CAST(sum(total_leads) AS BIGINT) AS total_leads,
       CAST(sum(total_take_up) AS BIGINT) AS total_take_up, count(DISTINCT campaign_id) AS total_campaigns,
       round({rate('sum(total_take_up)', 'sum(total_leads)')}, 2) AS take_up_rate
FROM master GROUP BY 1, 2""")
ORACLES["overview_trend"] = _q(f"""
SELECT *, row_number() OVER (ORDER BY period_start, period_end) AS position FROM (
  SELECT period_start, period_end, CAST(sum(total_leads) AS BIGINT) AS total_leads,
         CAST(sum(total_take_up) AS BIGINT) AS total_take_up,
         round({rate('sum(total_take_up)', 'sum(total_leads)')}, 2) AS take_up_rate
  FROM ov GROUP BY 1, 2) t""")
ORACLES["overview_trend_filtered"] = _q(f"""
SELECT campaign_id, period_start, period_end, total_leads, total_take_up, take_up_rate FROM (
  SELECT *, row_number() OVER (PARTITION BY period_start, period_end ORDER BY campaign_id) AS rn FROM (
    SELECT m.campaign_id, c.period_bucket AS period_start, c.period_end,
           CAST(sum(m.total_leads) AS BIGINT) AS total_leads,
           CAST(sum(m.total_take_up) AS BIGINT) AS total_take_up,
           round({rate('sum(m.total_take_up)', 'sum(m.total_leads)')}, 2) AS take_up_rate
    FROM master m JOIN camp c ON m.campaign_id = c.campaign_id
    WHERE m.campaign_id IN (SELECT campaign_id FROM enriched WHERE wilayah IN (1, 2, 3, 4, 5))
    GROUP BY 1, 2, 3) a) b
WHERE rn = 1""")

_WK = f"""campaign_id, region, week_start, leads_count, take_up_count,
       round({rate('take_up_count', 'leads_count')}, 4) AS take_up_rate, {r4('avg_transaction_value')}"""
ORACLES["regional_weekly"] = _q(f"SELECT {_WK} FROM weekly")
ORACLES["regional_summary"] = _q(f"""
SELECT campaign_id, region, CAST(sum(leads_count) AS BIGINT) AS leads_count,
       CAST(sum(take_up_count) AS BIGINT) AS take_up_count,
       round(avg(avg_transaction_value), 4) AS avg_of_weekly_avg,
       round({rate('sum(take_up_count)', 'sum(leads_count)')}, 4) AS take_up_rate
FROM weekly GROUP BY 1, 2""")
ORACLES["regional_trend_8w"] = _q(f"""
SELECT {_WK} FROM (
  SELECT *, row_number() OVER (PARTITION BY campaign_id, region ORDER BY week_start DESC) AS rn FROM weekly) t
WHERE rn <= 8""")
_REG = f"""campaign_id, wilayah, region_name, total_leads, total_take_up,
       round({rate('total_take_up', 'total_leads')}, 2) AS take_up_rate,
       CASE WHEN total_take_up > 0 THEN {cents_avg('value_sum', 'total_take_up')} ELSE 0.0 END AS avg_transaction_value"""
ORACLES["regional_from_leads"] = _q(f"SELECT {_REG} FROM reg")
ORACLES["regional_by_program"] = _q(f"""
SELECT campaign_id, wilayah, 'Wilayah ' || CAST(wilayah AS VARCHAR) AS region_name,
       count(*) AS total_leads,
       CAST(sum(CASE WHEN take_up_flag = 'YES' THEN 1 ELSE 0 END) AS BIGINT) AS total_take_up,
       round({rate("sum(CASE WHEN take_up_flag = 'YES' THEN 1 ELSE 0 END)", 'count(*)')}, 2) AS take_up_rate,
       CASE WHEN sum(CASE WHEN take_up_flag = 'YES' THEN 1 ELSE 0 END) > 0
            THEN {cents_avg("sum(CASE WHEN take_up_flag = 'YES' THEN coalesce(CAST(total_transaction_value AS DECIMAL(18, 2)), 0) END)", "sum(CASE WHEN take_up_flag = 'YES' THEN 1 ELSE 0 END)")}
            ELSE 0.0 END AS avg_transaction_value
FROM enriched WHERE wilayah IS NOT NULL AND flag_program = 'PROGRAM H2' GROUP BY 1, 2""")
ORACLES["regional_ranked"] = _q(f"""
SELECT *, CAST(row_number() OVER (PARTITION BY campaign_id ORDER BY take_up_rate DESC NULLS LAST, wilayah)
               AS INTEGER) AS region_rank,
       CASE WHEN take_up_rate >= 10 THEN 'high' WHEN take_up_rate >= 5 THEN 'medium' ELSE 'low' END AS rate_band
FROM (SELECT {_REG} FROM reg) t""")

ORACLES["take_up_leads"] = _q("""
SELECT campaign_id, cif, periode_start, take_up_date, media_blasting, wilayah, time_to_take_up_days
FROM enriched WHERE take_up_flag = 'YES' AND take_up_date IS NOT NULL""")


def _stats(by: str = "", where: str = "") -> str:
    keys = "campaign_id" + (f", {by}" if by else "")
    return _q(f"""
SELECT {keys}, CAST(min(d) AS INTEGER) AS min_days, CAST(max(d) AS INTEGER) AS max_days,
       round(avg(d), 1) AS mean_days, round(quantile_cont(CAST(d AS DOUBLE), 0.5), 1) AS median_days,
       count(*) AS total_take_up
FROM days {where} GROUP BY {keys}""")


ORACLES["time_stats"] = _stats()
ORACLES["time_stats_filtered"] = _stats(where="WHERE media_blasting = 'URGENT' AND wilayah = 3")
ORACLES["time_stats_by_channel"] = _stats("media_blasting")
ORACLES["time_stats_by_region"] = _stats("wilayah")
ORACLES["time_histogram"] = _q("""
, bins(bin_index, range_start, range_end) AS (
  VALUES (0, 0, 7), (1, 7, 14), (2, 14, 21), (3, 21, 30), (4, 30, 60), (5, 60, 90), (6, 90, NULL))
, tot AS (SELECT campaign_id, count(*) AS n FROM days GROUP BY 1)
SELECT t.campaign_id, CAST(b.bin_index AS INTEGER) AS bin_index, CAST(b.range_start AS INTEGER) AS range_start,
       CAST(b.range_end AS INTEGER) AS range_end, count(d.d) AS count,
       round(CAST(count(d.d) AS DOUBLE) / CAST(t.n AS DOUBLE) * 100.0, 2) AS percentage
FROM tot t CROSS JOIN bins b
LEFT JOIN days d ON d.campaign_id = t.campaign_id AND d.d >= b.range_start
                AND (b.range_end IS NULL OR d.d < b.range_end)
GROUP BY t.campaign_id, b.bin_index, b.range_start, b.range_end, t.n""")

_LONG = " UNION ALL ".join(
    f"SELECT campaign_id, '{a}' AS attribute, NULLIF(trim({a}), '') AS label, take_up_flag = 'YES' AS yes FROM enriched"
    for a in ["segment_by_aum", "range_usia", "media_blasting", "segment_div_owner", "flag_program"])
ORACLES["criteria_distribution"] = _q(f"""
, lng AS ({_LONG})
, cnt AS (SELECT campaign_id, attribute, label, count(*) AS count,
                 CAST(sum(CASE WHEN yes THEN 1 ELSE 0 END) AS BIGINT) AS take_up_count
          FROM lng WHERE label IS NOT NULL GROUP BY 1, 2, 3)
, pc AS (SELECT *, round(CAST(count AS DOUBLE) / CAST(sum(count) OVER (PARTITION BY campaign_id, attribute) AS DOUBLE) * 100.0, 4) AS p,
                row_number() OVER (PARTITION BY campaign_id, attribute ORDER BY label DESC) = 1 AS is_last
         FROM cnt)
SELECT campaign_id, attribute, label, count, take_up_count,
       CASE WHEN is_last
            THEN round(100.0 - sum(CASE WHEN is_last THEN 0.0 ELSE p END) OVER (PARTITION BY campaign_id, attribute), 4)
            ELSE p END AS percentage,
       round(CAST(take_up_count AS DOUBLE) / CAST(count AS DOUBLE) * 100.0, 4) AS take_up_percentage
FROM pc""")
ORACLES["criteria_availability"] = _q(f"""
, lng AS ({_LONG})
SELECT campaign_id, attribute, count(label) AS labelled_leads, count(label) > 0 AS available
FROM lng GROUP BY 1, 2""")

_CMP = f"""m.campaign_id, m.campaign_name, m.flag_program, m.total_leads, m.total_take_up,
       round({rate('m.total_take_up', 'm.total_leads')}, 2) AS take_up_rate,
       round(m.value_sum, 2) AS total_transaction_value,
       CAST(coalesce(date_diff('day', c.start_date, c.end_date), 0) AS INTEGER) AS duration_days"""
_CMP_FROM = "FROM metrics m LEFT JOIN catalogue c ON m.campaign_id = c.campaign_id"
ORACLES["compare_campaigns"] = _q(f"SELECT {_CMP} {_CMP_FROM}")
ORACLES["compare_requested"] = _q(f"""
SELECT r.id AS campaign_id, coalesce(x.total_leads, 0) AS total_leads, coalesce(x.total_take_up, 0) AS total_take_up,
       coalesce(x.take_up_rate, 0.0) AS take_up_rate, coalesce(x.total_transaction_value, 0.0) AS total_transaction_value,
       coalesce(x.duration_days, 0) AS duration_days, coalesce(x.campaign_name, '') AS campaign_name,
       coalesce(x.flag_program, '') AS flag_program
FROM (VALUES ('1-URGENT_1997-01-01'), ('2-HIGH_1996-05-01'), ('NO-SUCH_2000-01-01')) r(id)
LEFT JOIN (SELECT {_CMP} {_CMP_FROM}) x ON x.campaign_id = r.id""")
ORACLES["sort_by_attribute"] = _q(f"""
SELECT *, row_number() OVER (ORDER BY take_up_rate DESC NULLS LAST, campaign_id) AS position
FROM (SELECT {_CMP} {_CMP_FROM}) t""")
ORACLES["comparison_long"] = _q(f"""
, cm AS (SELECT {_CMP} {_CMP_FROM})
SELECT campaign_id, 'total_leads' AS metric, CAST(total_leads AS DOUBLE) AS value FROM cm
UNION ALL SELECT campaign_id, 'total_take_up', CAST(total_take_up AS DOUBLE) FROM cm
UNION ALL SELECT campaign_id, 'take_up_rate', take_up_rate FROM cm
UNION ALL SELECT campaign_id, 'total_transaction_value', total_transaction_value FROM cm
UNION ALL SELECT campaign_id, 'duration_days', CAST(duration_days AS DOUBLE) FROM cm""")


def _similar(k: int, where: str = "") -> str:
    return _q(f"""
SELECT campaign_id, similar_campaign_id, campaign_name, matching_dimensions, dimension_count,
       round(round(dimension_count / 3.0, 6), 4) AS similarity_score,
       round(round(take_up_rate, 6), 4) AS take_up_rate, total_leads, total_take_up, rank
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY campaign_id
                     ORDER BY dimension_count DESC, take_up_rate DESC, similar_campaign_id) AS INTEGER) AS rank
      FROM scored WHERE dimension_count >= 1 {where}) t
WHERE rank <= {k}""")


ORACLES["similarity_index"] = _similar(20)
ORACLES["similar_topk"] = _similar(5)
ORACLES["similar_by_dimensions"] = _similar(20, "AND mm")
ORACLES["similar_learning_summary"] = _q(f"""
, top AS (
  SELECT campaign_id, similar_campaign_id, take_up_rate FROM (
    SELECT *, row_number() OVER (PARTITION BY campaign_id
                                 ORDER BY dimension_count DESC, take_up_rate DESC, similar_campaign_id) AS rn
    FROM scored WHERE dimension_count = 3) t WHERE rn = 1)
SELECT d.campaign_id, t.similar_campaign_id AS top_similar_campaign_id,
       CASE WHEN t.similar_campaign_id IS NOT NULL
            THEN printf('%.2f%%', {sround(sround('t.take_up_rate', 6), 2)}) END AS take_up_rate_formatted,
       CASE WHEN t.similar_campaign_id IS NOT NULL THEN 'N/A' END AS top_segment,
       CASE WHEN t.similar_campaign_id IS NOT NULL THEN 'N/A' END AS top_region,
       CASE WHEN t.similar_campaign_id IS NULL
            THEN 'Tidak ada campaign serupa ditemukan. Coba perluas dimensi pencarian.' END AS message
FROM dim d LEFT JOIN top t ON d.campaign_id = t.campaign_id""")
ORACLES["similarity_counts"] = _q("""
SELECT campaign_id, dimension_count, count(*) AS similar_campaigns
FROM scored WHERE dimension_count >= 1 GROUP BY 1, 2""")

ORACLES["campaign_breakdowns"] = _q(f"""
SELECT campaign_id, breakdown, label, leads, take_up, {r4('take_up_rate')} FROM bdr""")
ORACLES["best_worst_segment"] = _q(f"""
SELECT campaign_id, best_segment, {r4('best_segment_rate')}, worst_segment, {r4('worst_segment_rate')}
FROM seg_bw""")
ORACLES["best_and_low_regions"] = _q(f"""
SELECT campaign_id, best_region, {r4('best_region_rate')}, low_regions FROM reg_bl""")
ORACLES["unused_channels"] = _q("""
SELECT campaign_id,
       array_to_string(list_filter(['wa', 'digisales', 'telesales', 'email', 'sms', 'push notif'],
                                   lambda x: x <> coalesce(lower(media_blasting), ''))[1:2], ',') AS suggested_channels
FROM rates""")
ORACLES["recommendation_facts"] = _q("""
SELECT r.campaign_id, r.take_up_rate, r.avg_days,
       s.best_segment, round(s.best_segment_rate, 4) AS best_segment_rate,
       s.worst_segment, round(s.worst_segment_rate, 4) AS worst_segment_rate,
       round(CASE WHEN s.best_segment_rate IS NULL THEN NULL
                  ELSE least(s.best_segment_rate - r.take_up_rate, 8.0) END, 4) AS segment_lift,
       CASE WHEN s.best_segment IS NULL THEN NULL
            WHEN s.best_segment_rate > r.take_up_rate * 1.5 THEN 'HIGH' ELSE 'MEDIUM' END AS segment_confidence,
       g.best_region, round(g.best_region_rate, 4) AS best_region_rate, g.low_regions,
       CASE WHEN round(b.best_similar_rate, 6) > r.take_up_rate THEN b.best_similar_id END AS best_similar_id,
       CASE WHEN round(b.best_similar_rate, 6) > r.take_up_rate
            THEN round(round(b.best_similar_rate, 6), 4) END AS best_similar_rate,
       CASE WHEN round(b.best_similar_rate, 6) > r.take_up_rate
            THEN round(least(round(b.best_similar_rate, 6) - r.take_up_rate, 10.0), 4) END AS similar_gain,
       CASE WHEN round(b.best_similar_rate, 6) > r.take_up_rate
            THEN CASE WHEN b.best_similar_score >= 0.8 THEN 'HIGH' ELSE 'MEDIUM' END END AS similar_confidence,
       CAST(coalesce(b.similar_count, 0) AS BIGINT) AS similar_count,
       CASE WHEN r.avg_days > 0 THEN CAST(greatest(7, floor(r.avg_days * 0.7)) AS INTEGER) END AS follow_up_days
FROM rates r
LEFT JOIN seg_bw s ON r.campaign_id = s.campaign_id
LEFT JOIN reg_bl g ON r.campaign_id = g.campaign_id
LEFT JOIN sim_best b ON r.campaign_id = b.campaign_id""")


# ---------------------------------------------------------------- filters, privacy, quality

_RAW_DATE = ("CASE o.o_orderkey % 4 WHEN 0 THEN strftime({d}, '%Y-%m-%d') WHEN 1 THEN strftime({d}, '%d/%m/%Y') "
             "WHEN 2 THEN strftime({d}, '%d-%m-%Y') ELSE strftime({d}, '%Y/%m/%d') END")
_D = "CAST(date_trunc('month', o.o_orderdate) AS DATE)"
ORACLES["filter_valid_cif"] = f"""
SELECT CAST(o.o_custkey AS VARCHAR) AS cif, o.o_orderpriority AS nama_program,
       'Y' || CAST(year(o.o_orderdate) AS VARCHAR) AS jenis_leads,
       lower(substr(o.o_orderpriority, 3)) AS media_blasting,
       {_RAW_DATE.format(d=_D)} AS periode_start,
       CASE WHEN month(o.o_orderdate) <= 6 THEN 'PROGRAM H1' ELSE 'PROGRAM H2' END AS flag_program,
       CAST(c.c_nationkey % 17 + 1 AS INTEGER) AS wilayah,
       CAST(o.o_orderkey % 340 AS INTEGER) AS cabang, CAST(o.o_orderkey % 100 AS INTEGER) AS outlet,
       CAST(NULL AS VARCHAR) AS segment_crs, c.c_mktsegment AS segment_by_aum,
       CAST(NULL AS VARCHAR) AS segment_wondr, o.o_orderstatus AS segment_div_owner,
       CASE WHEN c.c_acctbal < 0 THEN 'gen alpha' WHEN c.c_acctbal < 2500 THEN 'gen z'
            WHEN c.c_acctbal < 5000 THEN 'gen y' WHEN c.c_acctbal < 7500 THEN 'gen x'
            ELSE 'baby boomer' END AS range_usia,
       {sround('c.c_acctbal', 4)} AS range_saldo_tab, CAST(NULL AS DOUBLE) AS avg_aum_3_bln,
       {sround('o.o_totalprice', 4)} AS potensi_money
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"""
ORACLES["parse_mixed_dates"] = f"""
SELECT DISTINCT {_RAW_DATE.format(d=_D)} AS periode_text, {_D} AS periode_start FROM orders o"""
ORACLES["campaign_slug"] = _q("SELECT DISTINCT nama_program, periode_start, campaign_id FROM leads")
ORACLES["filter_leads_facets"] = _q("""
SELECT campaign_id, cif, periode_start, flag_program, media_blasting, wilayah, take_up_flag FROM enriched
WHERE flag_program IN ('PROGRAM H1') AND media_blasting IN ('URGENT', 'HIGH')
  AND wilayah IN (1, 2, 3, 4, 5, 6, 7, 8)
  AND (periode_start IS NULL OR periode_start BETWEEN DATE '1996-01-01' AND DATE '1999-12-31')""")
ORACLES["filter_period_range"] = _q("""
SELECT campaign_id, cif, periode_start FROM enriched
WHERE periode_start IS NULL OR periode_start BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'""")
ORACLES["filter_active"] = _q(f"""
SELECT {_OV} FROM ov
WHERE product IN ('PROGRAM H2') AND region IN ('1', '2', '3') AND channel IN ('URGENT', 'LOW')""")
ORACLES["filter_active_period"] = _q("""
SELECT campaign_id, nama_program, start_date, end_date, duration_days FROM catalogue
WHERE CAST(start_date AS VARCHAR) IN ('1997-03-01', '1998-03-01')""")
ORACLES["param_query"] = _q("""
SELECT product, channel, CAST(sum(total_leads) AS BIGINT) AS total_leads,
       CAST(sum(total_take_up) AS BIGINT) AS total_take_up
FROM ov WHERE granularity = 'monthly' AND total_leads >= 2 GROUP BY 1, 2""")
ORACLES["lenient_totals"] = _q("""
SELECT CAST(sum(total_leads) AS BIGINT) AS total_leads, CAST(sum(total_take_up) AS BIGINT) AS total_take_up,
       CAST(sum(campaign_count) AS BIGINT) AS campaign_count, count(*) AS rows_used,
       CAST(0 AS BIGINT) AS rows_skipped
FROM ov""")
ORACLES["strip_pii"] = _q(f"""
SELECT * EXCLUDE (cif, total_transaction_value), {r4('total_transaction_value')} FROM enriched""")
ORACLES["pii_report"] = _q("SELECT 'cif' AS path, count(cif) AS rows_with_value FROM enriched")


def _dom_set(c: str, values: list[str]) -> str:
    vals = ", ".join("'" + v.upper().replace("'", "''") + "'" for v in values)
    return (f"SELECT '{c}' AS column_name, "
            f"CAST(sum(CASE WHEN {c} IS NOT NULL AND upper({c}) NOT IN ({vals}) THEN 1 ELSE 0 END) AS BIGINT) AS violations, "
            f"count({c}) AS checked FROM leads")


def _dom_range(c: str, lo: int, hi: int) -> str:
    return (f"SELECT '{c}' AS column_name, "
            f"CAST(sum(CASE WHEN {c} IS NOT NULL AND {c} NOT BETWEEN {lo} AND {hi} THEN 1 ELSE 0 END) AS BIGINT) AS violations, "
            f"count({c}) AS checked FROM leads")


ORACLES["domain_violations"] = _q(" UNION ALL ".join([
    _dom_set("media_blasting", ["wa", "digisales", "telesales", "email", "push notif", "sms"]),
    _dom_set("flag_program", ["PROGRAM BIAYA ADMIN", "PROGRAM QRIS"]),
    _dom_set("segment_by_aum", ["UPPERMASS", "EMERALD", "MASS", "AFFLUENT", "PRIVATE", "HIGH AFFLUENT"]),
    _dom_set("range_usia", ["BABY BOOMER", "GEN X", "GEN Y", "GEN Z", "GEN ALPHA"]),
    _dom_set("segment_div_owner", ["CRS", "WEM (Perorangan)"]),
    _dom_range("wilayah", 1, 17), _dom_range("cabang", 1, 324), _dom_range("outlet", 0, 99)]))
ORACLES["negative_take_up"] = _q("""
SELECT campaign_id, count(*) AS negative_rows, CAST(min(time_to_take_up_days) AS INTEGER) AS min_gap_days
FROM enriched WHERE time_to_take_up_days < 0 GROUP BY 1""", ship_date=True)
ORACLES["etl_quality"] = _q("""
SELECT 'lead_rows' AS metric, count(*) AS value FROM lr
UNION ALL SELECT 'lead_blank_cif', CAST(0 AS BIGINT)
UNION ALL SELECT 'lead_bad_dates', CAST(0 AS BIGINT)
UNION ALL SELECT 'lead_null_campaign_id', CAST(0 AS BIGINT)
UNION ALL SELECT 'lead_duplicates_dropped',
                 count(*) - (SELECT count(*) FROM (SELECT DISTINCT cif, nama_program, periode_start FROM lr) k) FROM lr
UNION ALL SELECT 'monitoring_rows', count(*) FROM mon_all
UNION ALL SELECT 'monitoring_blank_cif', CAST(0 AS BIGINT)
UNION ALL SELECT 'monitoring_bad_dates', CAST(0 AS BIGINT)
UNION ALL SELECT 'monitoring_duplicates_dropped',
                 count(*) - (SELECT count(*) FROM (SELECT DISTINCT cif, nama_program, periode_start FROM mon_all) k)
          FROM mon_all
UNION ALL SELECT 'monitoring_without_lead', count(*) FROM mon_all m
          WHERE NOT EXISTS (SELECT 1 FROM lr l WHERE l.cif = m.cif AND l.nama_program = m.nama_program
                                                 AND l.periode_start = m.periode_start)""")

# ---------------------------------------------------------------- audit

_AK = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_AUDIT = f"""
WITH a AS (
  SELECT CAST(user_id AS VARCHAR) AS user_id, ts AS timestamp,
         'p' || CAST({_AK} % 5 AS VARCHAR) AS page_accessed, event_type AS action,
         'k=' || json_extract_string(props, '$.k') || '&page=p' || CAST({_AK} % 5 AS VARCHAR) AS request_params,
         CAST(floor(epoch(ts)) AS BIGINT) AS epoch_s,
         CAST(floor(epoch(ts)) AS BIGINT) + 7776000 AS expiry_timestamp,
         CAST(ts AS DATE) AS event_date
  FROM events)
"""
ORACLES["audit_params"] = _AUDIT + "SELECT user_id, timestamp, request_params FROM a"
ORACLES["audit_retention"] = _AUDIT + """
SELECT user_id, timestamp, page_accessed, action, expiry_timestamp FROM a
WHERE expiry_timestamp > CAST(epoch(TIMESTAMP '2024-04-15 00:00:00') AS BIGINT)"""
ORACLES["session_expiry"] = _AUDIT + """
, s AS (SELECT user_id, event_date, min(epoch_s) AS st FROM a GROUP BY 1, 2)
SELECT a.user_id, a.event_date, count(*) AS requests,
       CAST(sum(CASE WHEN a.epoch_s - s.st > 28800 THEN 1 ELSE 0 END) AS BIGINT) AS expired_requests
FROM a JOIN s ON a.user_id = s.user_id AND a.event_date = s.event_date GROUP BY 1, 2"""
ORACLES["audit_usage"] = _AUDIT + """
SELECT user_id, page_accessed, action, event_date, count(*) AS accesses FROM a GROUP BY 1, 2, 3, 4"""
ORACLES["audit_append"] = _AUDIT + """
SELECT user_id, timestamp, page_accessed, action, request_params, event_date FROM a"""
ORACLES["audit_stream"] = _AUDIT + "SELECT DISTINCT user_id, timestamp, page_accessed, action FROM a"

# ---------------------------------------------------------------- sources, sinks, pipelines

ORACLES["scan_leads_csv"] = _q("SELECT * FROM leads", csv=True)
ORACLES["scan_monitoring_csv"] = _q("""
SELECT cif, nama_program, periode_start, 'YES' AS take_up_flag, take_up_date,
       round(total_transaction_value, 4) AS total_transaction_value FROM mon""", csv=True)
ORACLES["pipeline_raw_to_clean"] = _q(ORACLES["campaign_master"][len(BASE):], csv=True)
ORACLES["sink_leads_partitioned"] = ORACLES["enrich_leads"]
ORACLES["campaign_lookup"] = _q("""
SELECT * EXCLUDE (total_transaction_value), round(total_transaction_value, 4) AS total_transaction_value
FROM enriched WHERE campaign_id = '1-URGENT_1997-01-01'""")
ORACLES["sink_campaigns_partitioned"] = ORACLES["campaign_master"]
ORACLES["scan_campaigns"] = ORACLES["campaign_master"]
ORACLES["scan_campaigns_year"] = _q(f"SELECT * FROM ({ORACLES['campaign_master'][len(BASE):]}) t WHERE year = 1997")
ORACLES["scan_enriched_leads"] = ORACLES["regional_weekly"]
ORACLES["sink_snapshot"] = ORACLES["overview_agg"]
ORACLES["pipeline_similarity"] = ORACLES["similarity_index"]
ORACLES["scan_json_array"] = _q("SELECT campaign_id, nama_program, start_date, end_date, duration_days FROM catalogue")
ORACLES["scan_json_map"] = _q(f"""
SELECT m.campaign_id, c.period_bucket AS period_start, c.period_end,
       CAST(sum(m.total_leads) AS BIGINT) AS total_leads, CAST(sum(m.total_take_up) AS BIGINT) AS total_take_up,
       round({rate('sum(m.total_take_up)', 'sum(m.total_leads)')}, 2) AS take_up_rate
FROM master m JOIN camp c ON m.campaign_id = c.campaign_id GROUP BY 1, 2, 3""")
ORACLES["export_campaign_table"] = _q(f"""
SELECT nama_program, flag_program, media_blasting, jenis_leads, CAST(wilayah AS VARCHAR) AS wilayah,
       total_leads, total_take_up,
       printf('%.2f%%', {sround(rate('total_take_up', 'total_leads'), 2)}) AS take_up_rate
FROM master""")

ORACLES["overview_lookback"] = _q(f"""
SELECT {_OV} FROM ov
WHERE period_start >= DATE '1999-12-31' - INTERVAL 90 DAY AND period_end <= DATE '1999-12-31'""")
ORACLES["external_tables"] = _q("""
SELECT t AS table_name, (SELECT CAST(sum(total_leads) AS BIGINT) FROM master) AS leads,
       (SELECT CAST(sum(total_take_up) AS BIGINT) FROM master) AS take_up
FROM (VALUES ('campaign'), ('leads'), ('campaign_overview_agg'), ('regional_performance_agg')) v(t)""")
ORACLES["similar_enriched"] = _q(f"""
SELECT s.*, d.flag_program AS similar_flag_program, d.jenis_leads AS similar_jenis_leads,
       d.media_blasting AS similar_media_blasting, d.periode_start AS similar_periode_start
FROM ({ORACLES["similarity_index"][len(BASE):]}) s
LEFT JOIN dim d ON s.similar_campaign_id = d.campaign_id""")

# a refresh must give what a rebuild gives
ORACLES["refresh_overview"] = ORACLES["overview_agg"]
ORACLES["refresh_totals"] = ORACLES["overview_totals_from_agg"]
ORACLES["refresh_regional"] = ORACLES["regional_weekly"]
ORACLES["refresh_campaigns"] = ORACLES["campaign_master"]

ORACLES["table_statistics"] = _q("""
SELECT 'leads' AS table_name, (SELECT count(*) FROM enriched) AS row_count, (SELECT count(DISTINCT campaign_id) FROM enriched) AS partitions
UNION ALL SELECT 'campaign', (SELECT count(*) FROM master), (SELECT count(*) FROM (SELECT DISTINCT year, month FROM master) t)
UNION ALL SELECT 'campaign_overview_agg', (SELECT count(*) FROM ov), 0
UNION ALL SELECT 'regional_performance_agg', (SELECT count(*) FROM weekly), 0""")
ORACLES["declared_campaign_year"] = _q("""
SELECT campaign_id, wilayah, year, month, total_leads FROM master WHERE year = 1997 AND month BETWEEN 3 AND 8""")
ORACLES["similar_lookup"] = _q(f"""
SELECT * FROM ({ORACLES["similarity_index"][len(BASE):]}) s WHERE campaign_id = '1-URGENT_1997-01-01' AND rank <= 10""")
ORACLES["similar_with_own_rate"] = _q(f"""
SELECT s.campaign_id, s.similar_campaign_id, s.rank, s.dimension_count, {sround('round(s.r, 6)', 4)} AS take_up_rate,
       {sround('d.take_up_rate', 4)} AS own_take_up_rate, d.total_leads AS own_total_leads,
       {sround('round(s.r, 6) - d.take_up_rate', 4)} AS rate_gain
FROM (SELECT campaign_id, similar_campaign_id, dimension_count, take_up_rate AS r,
             CAST(row_number() OVER (PARTITION BY campaign_id
                  ORDER BY dimension_count DESC, take_up_rate DESC, similar_campaign_id) AS INTEGER) AS rank
      FROM scored WHERE dimension_count >= 1) s JOIN dim d ON s.campaign_id = d.campaign_id
WHERE s.rank <= 20""")

# ---------------------------------------------------------------- one pass over spoilt files

_SPOILT = f"""
, rl AS (
  SELECT 'lead' AS src, CAST(o.o_custkey AS VARCHAR) AS cif, o.o_orderpriority AS nama,
         CASE WHEN NOT {_NO_DATE} THEN CAST(date_trunc('month', o.o_orderdate) AS DATE) END AS d,
         {_MISFIT} AS misfit, NOT {_MISFIT} AND {_BLANK} AS blank, {_NO_DATE} AS no_date
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
rm AS (
  SELECT 'monitoring' AS src, CAST(o.o_custkey AS VARCHAR) AS cif, o.o_orderpriority AS nama,
         CASE WHEN NOT {_NO_DATE} THEN CAST(date_trunc('month', o.o_orderdate) AS DATE) END AS d,
         {_MISFIT} AS misfit, NOT {_MISFIT} AND {_BLANK} AS blank, {_NO_DATE} AS no_date
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  WHERE l.l_returnflag = 'R'),
vl AS (SELECT cif, nama, d FROM rl WHERE NOT misfit AND NOT blank),
vm AS (SELECT cif, nama, d FROM rm WHERE NOT misfit AND NOT blank),
lone AS (SELECT * FROM vm WHERE NOT EXISTS (SELECT 1 FROM vl WHERE vl.cif = vm.cif AND vl.nama = vm.nama AND vl.d = vm.d)),
losses AS (
  SELECT 'lead_rows' AS metric, count(*) AS value FROM rl
  UNION ALL SELECT 'lead_malformed', count(*) FROM rl WHERE misfit
  UNION ALL SELECT 'lead_blank_cif', count(*) FROM rl WHERE blank
  UNION ALL SELECT 'lead_bad_dates', count(*) FROM rl WHERE no_date AND NOT misfit
  UNION ALL SELECT 'lead_null_campaign_id', count(*) FROM rl WHERE no_date AND NOT misfit
  UNION ALL SELECT 'lead_duplicates_dropped', count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM vl) t) FROM vl
  UNION ALL SELECT 'monitoring_rows', count(*) FROM rm
  UNION ALL SELECT 'monitoring_malformed', count(*) FROM rm WHERE misfit
  UNION ALL SELECT 'monitoring_blank_cif', count(*) FROM rm WHERE blank
  UNION ALL SELECT 'monitoring_bad_dates', 0
  UNION ALL SELECT 'monitoring_duplicates_dropped', count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM vm) t) FROM vm
  UNION ALL SELECT 'monitoring_without_lead', count(*) FROM lone
  UNION ALL SELECT 'monitoring_keys_without_lead', count(*) FROM (SELECT DISTINCT * FROM lone) t)
"""
ORACLES["etl_quality_raw"] = _q(_SPOILT + "SELECT * FROM losses")
ORACLES["etl_one_pass"] = _q(_SPOILT + "SELECT * FROM losses WHERE metric <> 'monitoring_without_lead'")
ORACLES["etl_quarantine"] = _q(_SPOILT + """
SELECT 'leads' AS source, 'malformed' AS status, count(*) AS rows_held, count(*) AS rows_with_text FROM rl WHERE misfit HAVING count(*) > 0
UNION ALL SELECT 'leads', 'blank_key', count(*), 0 FROM rl WHERE blank HAVING count(*) > 0
UNION ALL SELECT 'leads', 'no_campaign', count(*), 0 FROM (SELECT DISTINCT * FROM vl WHERE d IS NULL) t HAVING count(*) > 0
UNION ALL SELECT 'monitoring', 'malformed', count(*), count(*) FROM rm WHERE misfit HAVING count(*) > 0
UNION ALL SELECT 'monitoring', 'blank_key', count(*), 0 FROM rm WHERE blank HAVING count(*) > 0
UNION ALL SELECT 'monitoring', 'without_lead', count(*), 0 FROM (SELECT DISTINCT * FROM lone) t HAVING count(*) > 0""")
ORACLES["etl_clean_master"] = _q(ORACLES["campaign_master"][len(BASE):], csv=True, dirty=True)
ORACLES["dedup_by_arrival"] = _q("SELECT cif, campaign_id, 9 AS cabang FROM leads")

ORACLES["overview_stored"] = ORACLES["overview_agg"]
ORACLES["regional_stored"] = ORACLES["regional_weekly"]
ORACLES["time_stats_from_leads"] = ORACLES["time_stats"]
ORACLES["time_cube"] = _q("""
SELECT campaign_id, media_blasting, wilayah, d AS time_to_take_up_days, count(*) AS take_ups FROM days GROUP BY 1, 2, 3, 4""")
ORACLES["similarity_rates"] = _q(f"""
SELECT campaign_id, similar_campaign_id, {sround('dimension_count / 3.0', 6)} AS similarity_score, {sround('take_up_rate', 6)} AS take_up_rate
FROM (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY dimension_count DESC, take_up_rate DESC, similar_campaign_id) AS rank
      FROM scored WHERE dimension_count >= 1) t WHERE rank <= 20""")
