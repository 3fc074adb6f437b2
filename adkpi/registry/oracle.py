"""SQL twins of the registered queries, over the same given tables.

Written from the definitions, not from the Spark code: every step is spelled out with
plain joins, row numbers and full recomputation.
"""

from __future__ import annotations

ZONES = """
imp_zone AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS event_id, o_orderdate AS event_timestamp,
         o_orderdate AS ingest_ts, CAST(o_custkey AS VARCHAR) AS uid,
         CAST(o_custkey % 20 AS INTEGER) AS campaign, o_totalprice AS cost
  FROM orders
  UNION ALL
  SELECT CAST(o_orderkey AS VARCHAR), o_orderdate, o_orderdate + INTERVAL 1 DAY,
         CAST(o_custkey AS VARCHAR), CAST(o_custkey % 20 AS INTEGER), o_totalprice * 2
  FROM orders WHERE o_orderstatus = 'P'
),
clk_zone AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS event_id, l_shipdate AS ingest_ts
  FROM lineitem WHERE l_returnflag IN ({flags})
),
cnv_zone AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS event_id, l_shipdate AS ingest_ts,
         greatest(CAST(epoch(l_shipdate) AS BIGINT) - CAST(epoch(o_orderdate) AS BIGINT), 0)
           AS conversion_delay_sec
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_returnflag = 'R'
)"""


def _silver(name: str, before: str | None = None) -> str:
    """Silver as CTEs; with ``before`` only from zone rows ingested before that day."""
    limit = "WHERE event_id IS NOT NULL"
    if before:
        limit += f" AND CAST(ingest_ts AS DATE) < DATE '{before}'"
    return f"""
{name}_imp AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (
      PARTITION BY event_id
      ORDER BY ingest_ts DESC NULLS LAST, event_timestamp DESC NULLS LAST,
               cost DESC NULLS LAST, campaign DESC NULLS LAST, uid DESC NULLS LAST) AS rn
    FROM imp_zone {limit}) WHERE rn = 1
),
{name}_cnv AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (
      PARTITION BY event_id
      ORDER BY ingest_ts DESC NULLS LAST, conversion_delay_sec DESC NULLS LAST) AS rn
    FROM cnv_zone {limit}) WHERE rn = 1
),
{name}_clk AS (SELECT DISTINCT event_id FROM clk_zone {limit}),
{name} AS (
  SELECT i.event_id, CAST(i.event_timestamp AS DATE) AS event_date, i.uid, i.campaign,
         CASE WHEN k.event_id IS NULL THEN 0 ELSE 1 END AS click,
         CASE WHEN c.event_id IS NULL THEN 0 ELSE 1 END AS conversion,
         c.conversion_delay_sec, i.cost
  FROM {name}_imp i
  LEFT JOIN {name}_clk k ON i.event_id = k.event_id
  LEFT JOIN {name}_cnv c ON i.event_id = c.event_id
)"""


def _kpis(name: str, silver: str) -> str:
    return f"""
{name}_base AS (
  SELECT event_date AS summary_date, campaign,
         count(*) AS impressions,
         CAST(sum(click) AS BIGINT) AS clicks,
         CAST(sum(conversion) AS BIGINT) AS conversions,
         sum(cost) AS total_cost,
         CAST(sum(CASE WHEN conversion = 1 AND conversion_delay_sec > 3600
                       THEN 1 ELSE 0 END) AS BIGINT) AS late_conversion_count,
         avg(CASE WHEN conversion = 1 THEN CAST(conversion_delay_sec AS DOUBLE) END)
           AS avg_delay,
         CAST(quantile_disc(CASE WHEN conversion = 1 THEN conversion_delay_sec END, 0.5)
           AS DOUBLE) AS p50_delay,
         CAST(quantile_disc(CASE WHEN conversion = 1 THEN conversion_delay_sec END, 0.95)
           AS DOUBLE) AS p95_delay
  FROM {silver} GROUP BY event_date, campaign
),
{name} AS (
  SELECT summary_date, campaign, impressions, clicks, conversions, total_cost,
         CASE WHEN impressions > 0 THEN clicks * CAST(100 AS DOUBLE) / impressions
              ELSE 0 END AS ctr,
         CASE WHEN clicks > 0 THEN conversions * CAST(100 AS DOUBLE) / clicks
              ELSE 0 END AS cvr,
         CASE WHEN conversions > 0 THEN total_cost / conversions END AS cpa,
         late_conversion_count,
         CASE WHEN conversions > 0
              THEN late_conversion_count * CAST(100 AS DOUBLE) / conversions
              ELSE 0 END AS late_conversion_ratio,
         avg_delay AS avg_conversion_delay_sec,
         p50_delay AS p50_conversion_delay_sec,
         p95_delay AS p95_conversion_delay_sec
  FROM {name}_base
)"""


KPI_COLUMNS = """summary_date, campaign, impressions, clicks, conversions,
  round(total_cost, 6) AS total_cost, round(ctr, 6) AS ctr, round(cvr, 6) AS cvr,
  round(cpa, 6) AS cpa, late_conversion_count,
  round(late_conversion_ratio, 6) AS late_conversion_ratio,
  round(avg_conversion_delay_sec, 6) AS avg_conversion_delay_sec,
  round(p50_conversion_delay_sec, 6) AS p50_conversion_delay_sec,
  round(p95_conversion_delay_sec, 6) AS p95_conversion_delay_sec"""

RECORDS = """
raw_records AS (
  SELECT o.o_orderkey AS row_key,
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'unknown'
              ELSE CAST(CAST(epoch(o_orderdate) AS BIGINT) AS VARCHAR) END AS ts_text,
         CAST(o_custkey AS VARCHAR) AS uid,
         CAST(o_custkey % 20 AS VARCHAR) AS campaign,
         CASE WHEN l.clicked = 1 THEN '1' WHEN o_orderstatus = 'F' THEN '' ELSE '0' END
           AS click_text,
         CASE WHEN l.converted_at IS NULL THEN '0' ELSE '1' END AS conversion_text,
         CASE WHEN l.converted_at IS NOT NULL THEN CAST(l.converted_at AS VARCHAR)
              WHEN o_orderstatus = 'O' THEN '-1' ELSE '' END AS conversion_ts_text,
         CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE CAST(o_totalprice AS VARCHAR) END
           AS cost_text
  FROM orders o
  LEFT JOIN (
    SELECT l_orderkey,
           max(CASE WHEN l_returnflag IN ('N', 'R') THEN 1 END) AS clicked,
           max(CASE WHEN l_returnflag = 'R' THEN CAST(epoch(l_shipdate) AS BIGINT) END)
             AS converted_at
    FROM lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey
),
shift AS (
  SELECT CASE WHEN max(TRY_CAST(ts_text AS BIGINT)) < 1000000000
              THEN 1778803200 ELSE 0 END AS seconds
  FROM raw_records
),
records AS (
  SELECT row_key,
         coalesce(TRY_CAST(ts_text AS BIGINT), 0) + (SELECT seconds FROM shift) AS ts,
         uid, campaign,
         coalesce(TRY_CAST(click_text AS BIGINT), 0) AS click,
         coalesce(TRY_CAST(conversion_text AS BIGINT), 0) AS conversion,
         CASE WHEN TRY_CAST(conversion_ts_text AS BIGINT) > 0
              THEN TRY_CAST(conversion_ts_text AS BIGINT) + (SELECT seconds FROM shift) END
           AS conversion_ts,
         CASE WHEN cost_text = '' THEN 0.0 ELSE TRY_CAST(cost_text AS DOUBLE) END AS cost
  FROM raw_records
),
placed AS (
  SELECT *, row_number() OVER (ORDER BY ts, row_key) - 1 AS position FROM records
),
numbered AS (SELECT *, printf('evt_%08d', position) AS event_id FROM placed)"""

_CLICK_WAIT = "CAST('0x' || substr(md5('42|' || event_id), 1, 8) AS BIGINT) % 30 + 1"
_ISO = "strftime(make_timestamp({0} * 1000000), '%Y-%m-%dT%H:%M:%S')"

IMPRESSION_EVENTS = f"""
SELECT event_id, 'impression' AS event_type, ts AS "timestamp", {_ISO.format("ts")} AS event_time,
       uid, CAST(campaign AS INTEGER) AS campaign, cost
FROM numbered"""

CLICK_EVENTS = f"""
SELECT event_id, 'click' AS event_type, ts + {_CLICK_WAIT} AS "timestamp",
       {_ISO.format(f"(ts + {_CLICK_WAIT})")} AS event_time,
       ts AS impression_timestamp, uid, CAST(campaign AS INTEGER) AS campaign
FROM numbered WHERE click <> 0"""

CONVERSION_EVENTS = f"""
SELECT event_id, 'conversion' AS event_type, conversion_ts AS "timestamp",
       {_ISO.format("conversion_ts")} AS event_time,
       ts AS impression_timestamp, uid, CAST(campaign AS INTEGER) AS campaign,
       greatest(conversion_ts - ts, 0) AS conversion_delay_sec
FROM numbered WHERE conversion <> 0 AND conversion_ts IS NOT NULL"""

CLEAN = ZONES.format(flags="'N', 'R'")
VIEW_THROUGH = ZONES.format(flags="'N'")
SILVER = f"WITH {CLEAN}, {_silver('silver')}"
SILVER_VIEW_THROUGH = f"WITH {VIEW_THROUGH}, {_silver('silver')}"

# Target: what had come in before the cut day. Source: the merge window of full silver.
MERGE = f"""{SILVER}, {_silver('early', '1998-01-01')},
source AS (SELECT * FROM silver WHERE event_date >= DATE '2000-01-01' - 1095)"""

MERGED = """
merged AS (
  SELECT * FROM source
  UNION ALL
  SELECT * FROM early WHERE event_id NOT IN (SELECT event_id FROM source)
)"""



def _parsed(kind: str, more: str = "") -> str:
    """Messages of one kind, read back: what is no JSON has its text and nothing else."""
    good = "CASE WHEN NOT bad THEN {} END AS {}".format
    fields = [
        good("CAST(event_id AS VARCHAR)", "event_id"),
        good(f"'{kind}'", "event_type"),
        good("CAST(floor(epoch(ts)) AS BIGINT)", '"timestamp"'),
        "CAST(NULL AS VARCHAR) AS event_time",
        good("CAST(floor(epoch(ts)) AS BIGINT) - user_id", "impression_timestamp"),
        good("CAST(user_id AS VARCHAR)", "uid"),
        good(
            "CAST(CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS BIGINT) % 20 AS INTEGER)",
            "campaign",
        ),
        good("CAST(ts AS DATE)", "event_date"),
    ]
    return f"""WITH m AS (SELECT *, event_type = 'error' AS bad FROM events)
SELECT event_id AS kafka_offset, {", ".join(fields)}{more},
       CASE WHEN bad THEN 'broken ' || CAST(event_id AS VARCHAR) END AS raw_value,
       bad AS is_malformed, CAST(ts AS DATE) AS raw_date, CAST(hour(ts) AS INTEGER) AS raw_hour
FROM m"""


ORACLE: dict[str, str] = {
    "bronze_parse_clicks": _parsed("click"),
    "bronze_parse_conversions": _parsed(
        "conversion",
        ", CASE WHEN NOT bad THEN CAST(user_id AS BIGINT) END AS conversion_delay_sec",
    ),
    "zone_scan": f"""WITH {CLEAN}
SELECT 'impression' AS zone, event_id, CAST(ingest_ts AS DATE) AS raw_date FROM imp_zone
UNION ALL SELECT 'click', event_id, CAST(ingest_ts AS DATE) FROM clk_zone
UNION ALL SELECT 'conversion', event_id, CAST(ingest_ts AS DATE) FROM cnv_zone""",
    "latest_per_event": f"""{SILVER}
SELECT event_id, CAST(ingest_ts AS DATE) AS ingest_date, uid, campaign, cost FROM silver_imp""",
    "silver_events": f"{SILVER} SELECT * FROM silver",
    "silver_events_view_through": f"{SILVER_VIEW_THROUGH} SELECT * FROM silver",
    "orphan_events": f"""WITH {CLEAN}
SELECT DISTINCT zone, event_id FROM (
  SELECT 'click' AS zone, event_id, ingest_ts FROM clk_zone
  UNION ALL SELECT 'conversion', event_id, ingest_ts FROM cnv_zone) e
WHERE CAST(ingest_ts AS DATE) < DATE '1998-01-01'
  AND NOT EXISTS (SELECT 1 FROM imp_zone i WHERE i.event_id = e.event_id
                  AND CAST(i.ingest_ts AS DATE) < DATE '1998-01-01')""",
    "incremental_silver": f"""{SILVER}
SELECT * FROM silver WHERE event_id IN (
  SELECT event_id FROM imp_zone WHERE CAST(ingest_ts AS DATE) >= DATE '2001-06-01'
  UNION SELECT event_id FROM clk_zone WHERE CAST(ingest_ts AS DATE) >= DATE '2001-06-01'
  UNION SELECT event_id FROM cnv_zone WHERE CAST(ingest_ts AS DATE) >= DATE '2001-06-01')""",
    "recent_window": f"""{SILVER}
SELECT * FROM silver WHERE event_date >= DATE '2001-08-01' - 365""",
    "campaign_daily_base": f"""{SILVER}, {_kpis('kpis', 'silver')}
SELECT summary_date, campaign, impressions, clicks, conversions,
       round(total_cost, 6) AS total_cost FROM kpis""",
    "campaign_kpis": f"{SILVER}, {_kpis('kpis', 'silver')} SELECT {KPI_COLUMNS} FROM kpis",
    "campaign_kpis_view_through": f"""{SILVER_VIEW_THROUGH}, {_kpis('kpis', 'silver')}
SELECT {KPI_COLUMNS} FROM kpis""",
    "late_conversions": f"""{SILVER}, {_kpis('kpis', 'silver')}
SELECT summary_date, campaign, conversions, late_conversion_count,
       round(late_conversion_ratio, 6) AS late_conversion_ratio FROM kpis""",
    "delay_distribution": f"""{SILVER}, {_kpis('kpis', 'silver')}
SELECT summary_date, campaign,
       round(avg_conversion_delay_sec, 6) AS avg_conversion_delay_sec,
       round(p50_conversion_delay_sec, 6) AS p50_conversion_delay_sec,
       round(p95_conversion_delay_sec, 6) AS p95_conversion_delay_sec FROM kpis""",
    "campaign_totals": f"""{SILVER}, by_campaign AS (SELECT * REPLACE (NULL AS event_date) FROM silver),
{_kpis('kpis', 'by_campaign')}
SELECT campaign, impressions, clicks, conversions, round(total_cost, 2) AS total_cost,
       round(ctr, 4) AS ctr, round(cvr, 4) AS cvr, round(cpa, 4) AS cpa, late_conversion_count,
       round(late_conversion_ratio, 4) AS late_conversion_ratio,
       round(avg_conversion_delay_sec, 4) AS avg_conversion_delay_sec,
       round(p50_conversion_delay_sec, 4) AS p50_conversion_delay_sec,
       round(p95_conversion_delay_sec, 4) AS p95_conversion_delay_sec FROM kpis""",
    "quality_violations": f"""WITH {CLEAN}, {_silver('clean')}, {_kpis('clean_kpis', 'clean')},
vt_clk AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS event_id
           FROM lineitem WHERE l_returnflag = 'N'),
vt AS (SELECT s.* REPLACE (CASE WHEN k.event_id IS NULL THEN 0 ELSE 1 END AS click)
       FROM clean s LEFT JOIN vt_clk k ON s.event_id = k.event_id),
{_kpis('vt_kpis', 'vt')},
every_kpi AS (SELECT 'clean' AS variant, * FROM clean_kpis
        UNION ALL SELECT 'view_through', * FROM vt_kpis)
SELECT variant,
       count(*) FILTER (WHERE impressions <= 0) AS impressions_not_positive,
       count(*) FILTER (WHERE ctr < 0 OR ctr > 100) AS ctr_out_of_range,
       count(*) FILTER (WHERE cvr < 0 OR cvr > 100) AS cvr_out_of_range,
       count(*) FILTER (WHERE impressions <= 0 OR ctr < 0 OR ctr > 100
                           OR cvr < 0 OR cvr > 100) AS violating_rows
FROM every_kpi GROUP BY variant""",
    "silver_upsert": f"{MERGE}, {MERGED} SELECT * FROM merged",
    "silver_changed_rows": f"{MERGE} SELECT * FROM source EXCEPT SELECT * FROM early",
    "gold_upsert": f"""{MERGE}, {_kpis('target', 'early')}, {_kpis('update', 'source')}
SELECT {KPI_COLUMNS} FROM (
  SELECT * FROM update
  UNION ALL
  SELECT t.* FROM target t WHERE NOT EXISTS (
    SELECT 1 FROM update u WHERE u.summary_date IS NOT DISTINCT FROM t.summary_date
      AND u.campaign IS NOT DISTINCT FROM t.campaign))""",
    "partition_overwrite": f"""{MERGE},
converted AS (SELECT * FROM source WHERE conversion = 1)
SELECT * FROM converted
UNION ALL
SELECT * FROM early WHERE event_date NOT IN (SELECT event_date FROM converted)""",
    "late_correction": f"""{MERGE}, {MERGED},
{_kpis('before', 'early')}, {_kpis('after', 'merged')}
SELECT a.summary_date, a.campaign,
       b.impressions AS impressions_before, b.clicks AS clicks_before,
       b.conversions AS conversions_before,
       b.late_conversion_count AS late_conversion_count_before,
       round(b.cvr, 6) AS cvr_before, round(b.cpa, 6) AS cpa_before,
       a.impressions AS impressions_after, a.clicks AS clicks_after,
       a.conversions AS conversions_after,
       a.late_conversion_count AS late_conversion_count_after,
       round(a.cvr, 6) AS cvr_after, round(a.cpa, 6) AS cpa_after
FROM after a LEFT JOIN before b
  ON a.summary_date IS NOT DISTINCT FROM b.summary_date
 AND a.campaign IS NOT DISTINCT FROM b.campaign
WHERE a.impressions IS DISTINCT FROM b.impressions OR a.clicks IS DISTINCT FROM b.clicks
   OR a.conversions IS DISTINCT FROM b.conversions
   OR a.late_conversion_count IS DISTINCT FROM b.late_conversion_count
   OR round(a.cvr, 6) IS DISTINCT FROM round(b.cvr, 6)
   OR round(a.cpa, 6) IS DISTINCT FROM round(b.cpa, 6)""",
    "bronze_parse": """WITH m AS (
  SELECT *, event_type = 'error' AS bad FROM events)
SELECT event_id AS kafka_offset,
       CASE WHEN NOT bad THEN CAST(event_id AS VARCHAR) END AS event_id,
       CASE WHEN NOT bad THEN 'impression' END AS event_type,
       CASE WHEN NOT bad THEN CAST(floor(epoch(ts)) AS BIGINT) END AS "timestamp",
       CAST(NULL AS VARCHAR) AS event_time,
       CASE WHEN NOT bad THEN CAST(user_id AS VARCHAR) END AS uid,
       CASE WHEN NOT bad
            THEN CAST(CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) % 20
                      AS INTEGER) END AS campaign,
       CASE WHEN NOT bad THEN round(value, 6) END AS cost,
       CASE WHEN bad THEN 'broken ' || CAST(event_id AS VARCHAR) END AS raw_value,
       bad AS is_malformed,
       CASE WHEN NOT bad THEN CAST(ts AS DATE) END AS event_date,
       CAST(ts AS DATE) AS raw_date,
       CAST(hour(ts) AS INTEGER) AS raw_hour
FROM m""",
    "rejected_messages": """SELECT event_id AS kafka_offset, CAST(ts AS DATE) AS raw_date,
       'broken ' || CAST(event_id AS VARCHAR) AS raw_value
FROM events WHERE event_type = 'error'""",
    "normalise_events": f"""WITH {RECORDS}
SELECT row_key, ts AS "timestamp", uid, campaign, click, conversion,
       conversion_ts AS conversion_timestamp, round(cost, 6) AS cost FROM records""",
    "rebase_timestamps": """WITH rows_in AS (
  SELECT 'orders' AS source, o_orderkey AS row_key,
         CAST(floor(epoch(o_orderdate)) AS BIGINT) AS ts FROM orders
  UNION ALL
  SELECT 'events', event_id, CAST(floor(epoch(ts)) AS BIGINT) FROM events),
shifts AS (
  SELECT source, CASE WHEN max(ts) < 1000000000 THEN 1778803200 ELSE 0 END AS seconds
  FROM rows_in GROUP BY source)
SELECT r.source, r.row_key, r.ts + s.seconds AS "timestamp"
FROM rows_in r JOIN shifts s ON r.source = s.source""",
    "timestamp_range": f"""WITH {RECORDS}
SELECT min(TRY_CAST(ts_text AS BIGINT)) AS min_ts, max(TRY_CAST(ts_text AS BIGINT)) AS max_ts,
       count(*) AS row_count FROM raw_records""",
    "dataset_profile": f"""WITH {RECORDS}, totals AS (
  SELECT count(*) AS total, CAST(sum(click) AS BIGINT) AS clicks,
         CAST(sum(conversion) AS BIGINT) AS conversions, sum(cost) AS total_cost,
         count(DISTINCT campaign) AS campaigns, min(ts) AS min_ts, max(ts) AS max_ts,
         coalesce(avg(CASE WHEN conversion <> 0 AND conversion_ts > ts
                           THEN conversion_ts - ts END) / 3600, 0.0) AS avg_delay_hours
  FROM records)
SELECT total, clicks, conversions, round(total_cost, 2) AS total_cost, campaigns,
       min_ts, max_ts, round(avg_delay_hours, 4) AS avg_delay_hours,
       round(CASE WHEN total > 0 THEN clicks * CAST(100 AS DOUBLE) / total END, 4) AS ctr,
       round(CASE WHEN clicks > 0 THEN conversions * CAST(100 AS DOUBLE) / clicks END, 4)
         AS cvr,
       round(CASE WHEN conversions > 0 THEN total_cost / conversions END, 4) AS cpa,
       coalesce(strftime(make_timestamp(min_ts * 1000000), '%Y-%m-%d %H:%M') || ' ~ '
             || strftime(make_timestamp(max_ts * 1000000), '%Y-%m-%d %H:%M'), 'N/A')
         AS period
FROM totals""",
    "sorted_events": f"""WITH {RECORDS}
SELECT ts AS "timestamp", row_key, uid, campaign, click, conversion FROM records
ORDER BY ts, row_key""",
    "first_events": f"""WITH {RECORDS}
SELECT row_key, ts AS "timestamp", uid, campaign, click, conversion,
       conversion_ts AS conversion_timestamp, round(cost, 6) AS cost
FROM records ORDER BY ts, row_key LIMIT 1000""",
    "fixed_size_sample": """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
ORDER BY md5('42|' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 1000""",
    "batch_split": f"""WITH {RECORDS}
SELECT row_key, ts AS "timestamp", position,
       CASE WHEN position < 8000 THEN 'initial' WHEN position < 8200 THEN 'batch_01'
            WHEN position < 8500 THEN 'batch_02' WHEN position < 8900 THEN 'batch_03'
            WHEN position < 9400 THEN 'batch_04' WHEN position < 10000 THEN 'batch_05'
            ELSE 'rest' END AS split
FROM placed
UNION ALL
SELECT row_key, ts, position, 'sample' FROM placed WHERE position < 1000""",
    "explode_impressions": f"WITH {RECORDS} {IMPRESSION_EVENTS}",
    "explode_clicks": f"WITH {RECORDS} {CLICK_EVENTS}",
    "explode_conversions": f"WITH {RECORDS} {CONVERSION_EVENTS}",
    "conversion_delay": f"""WITH {RECORDS}
SELECT row_key, greatest(conversion_ts - ts, 0) AS conversion_delay_sec
FROM records WHERE conversion_ts IS NOT NULL""",
    "event_payloads": f"""WITH {RECORDS},
impression AS ({IMPRESSION_EVENTS}),
click AS ({CLICK_EVENTS}),
conversion AS ({CONVERSION_EVENTS}),
head AS (
  SELECT event_id, uid, 'ad-impressions' AS topic,
         ',"uid":"' || uid || '","campaign":' || campaign || ',"cost":' || cost || '}}' AS tail,
         event_type, "timestamp", event_time FROM impression
  UNION ALL
  SELECT event_id, uid, 'ad-clicks',
         ',"impression_timestamp":' || impression_timestamp || ',"uid":"' || uid
           || '","campaign":' || campaign || '}}',
         event_type, "timestamp", event_time FROM click
  UNION ALL
  SELECT event_id, uid, 'ad-conversions',
         ',"impression_timestamp":' || impression_timestamp || ',"uid":"' || uid
           || '","campaign":' || campaign || ',"conversion_delay_sec":' || conversion_delay_sec
           || '}}',
         event_type, "timestamp", event_time FROM conversion)
SELECT uid AS key, topic,
       '{{"event_id":"' || event_id || '","event_type":"' || event_type || '","timestamp":'
         || "timestamp" || ',"event_time":"' || event_time || '"' || tail AS value
FROM head""",
}
