"""The star-schema tables as relations of the catalogue.

Each relation is one SELECT that Spark and DuckDB both run; only the text of a date differs.
"""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

#: The frozen clock of all queries.
NOW = datetime(1998, 6, 15, 12, tzinfo=timezone.utc)

_DAY = {"spark": "date_format({}, 'yyyy-MM-dd')", "duckdb": "strftime({}, '%Y-%m-%d')"}
_TIME = {"spark": "date_format({}, 'HH:mm')", "duckdb": "strftime({}, '%H:%M')"}

_SQL = {
    "plans": """
WITH ship AS (SELECT l_orderkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_orderkey),
many AS (SELECT count(*) AS n FROM documents),
titled AS (
  SELECT o.*, split_part(coalesce(d.text, ''), chr(10), 1) AS title, coalesce(d.text, '') AS body
  FROM orders o CROSS JOIN many JOIN documents d ON d.doc_id = o.o_orderkey % many.n)
SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 10 < 7 THEN 'event' WHEN o_orderkey % 10 = 7 THEN 'place' WHEN o_orderkey % 10 = 8 THEN 'Route' ELSE 'activity' END AS kind,
  concat('fp-', CAST(o_custkey AS STRING), '-', CAST(o_orderkey % 4 AS STRING)) AS fingerprint,
  'ca' AS original_language,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE title END AS original_title,
  CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE body END AS original_description,
  CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN NULL ELSE title END AS title_ca,
  CASE WHEN o_orderkey % 3 = 0 THEN concat('ES ', title) WHEN o_orderkey % 4 = 0 THEN '' END AS title_es,
  CASE WHEN o_orderkey % 2 = 0 THEN c_name END AS subtitle_ca,
  CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN n_name END AS subtitle_es,
  CASE WHEN o_orderkey % 6 = 0 THEN '' END AS description_ca,
  CASE WHEN o_orderkey % 8 = 0 THEN title END AS description_es,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN 'soon' ELSE {day_start} END AS start_date,
  CASE WHEN o_orderkey % 89 = 0 THEN '' WHEN o_orderkey % 101 = 0 THEN '2031-02-30' WHEN o_orderkey % 103 = 0 THEN '2031-01-31' ELSE {day_end} END AS end_date,
  CASE WHEN o_orderkey % 9 = 0 THEN '10:00' END AS schedule_text,
  CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS permanent,
  CASE WHEN o_orderkey % 4 = 1 THEN '12 EUR' WHEN o_orderkey % 4 = 2 THEN '' END AS price_text,
  CASE WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 3 = 1 THEN 0 END AS is_free,
  CASE WHEN o_orderkey % 53 = 0 THEN 'Fora de Catalunya' ELSE r_name END AS province,
  CASE WHEN o_orderkey % 59 = 0 THEN 'OUTSIDE of Spain' ELSE n_name END AS comarca,
  CASE WHEN o_orderkey % 41 = 0 THEN '' WHEN o_orderkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS municipality,
  CASE WHEN o_orderkey % 6 = 1 THEN n_name END AS locality,
  CASE WHEN o_orderkey % 5 = 2 THEN NULL ELSE concat(c_name, ', ', CAST(o_orderkey % 30 AS STRING)) END AS address,
  concat('08', CAST(100 + o_orderkey % 900 AS STRING)) AS postal_code,
  CASE WHEN o_orderkey % 7 = 3 THEN NULL ELSE c_name END AS venue_name,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(41 AS DOUBLE) + CAST(o_orderkey % 100 AS DOUBLE) / 1000 END AS latitude,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE CAST(2 AS DOUBLE) + CAST(o_orderkey % 70 AS DOUBLE) / 1000 END AS longitude,
  CASE WHEN o_orderkey % 5 <> 0 THEN concat('https://plans.example/', CAST(o_orderkey AS STRING)) END AS website_url,
  CASE WHEN o_orderkey % 5 = 0 THEN 'ftp://x.example/a' ELSE 'http://tickets.example/a' END AS ticket_url,
  concat('https://img.example/', CAST(o_orderkey AS STRING)) AS image_url,
  CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS image_reuse_allowed,
  CASE WHEN o_orderkey % 6 = 0 THEN 1 WHEN o_orderkey % 6 = 1 THEN 0 END AS family_friendly,
  CASE WHEN o_orderkey % 10 = 0 THEN 1 WHEN o_orderkey % 10 = 1 THEN 0 END AS indoor,
  CASE WHEN o_orderkey % 12 = 0 THEN 1 WHEN o_orderkey % 12 = 1 THEN 0 END AS outdoor,
  CAST(NULL AS STRING) AS recommended_months,
  CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END AS featured,
  CAST((o_orderkey * 7) % 101 AS INT) AS quality_score,
  CASE WHEN o_orderstatus = 'P' THEN 'inactive' WHEN o_orderkey % 71 = 0 THEN 'cancelled' ELSE 'active' END AS status,
  '1997-01-01T00:00:00.000Z' AS created_at, '1998-01-01T00:00:00.000Z' AS updated_at,
  CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 <> 0 THEN concat('1998-06-', CASE WHEN o_orderkey % 14 < 9 THEN '0' ELSE '' END, CAST(1 + o_orderkey % 14 AS STRING), 'T12:00:00.000Z') END AS inactive_at
FROM titled JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey LEFT JOIN ship ON l_orderkey = o_orderkey
""",
    "categories": """
SELECT CAST(row_number() OVER (ORDER BY p_type) AS BIGINT) AS id, lower(p_type) AS slug, p_type AS name_ca,
  CASE WHEN length(p_type) % 2 = 0 THEN '' ELSE concat('ES ', p_type) END AS name_es, 'general' AS group_name, lower(p_type) AS icon
FROM (SELECT DISTINCT p_type FROM part) t
""",
    "plan_categories": """
SELECT DISTINCT l_orderkey AS plan_id, c.id AS category_id FROM lineitem JOIN part AS part ON p_partkey = l_partkey
JOIN (SELECT CAST(row_number() OVER (ORDER BY p_type) AS BIGINT) AS id, p_type FROM (SELECT DISTINCT p_type FROM part) t) c ON c.p_type = part.p_type
""",
    "sources": """
SELECT CAST(s_suppkey AS BIGINT) AS id, CASE WHEN s_suppkey % 5 = 0 THEN 'agenda' WHEN s_suppkey % 5 = 1 THEN 'feed' ELSE concat('s', CAST(s_suppkey AS STRING)) END AS key, s_name AS name, 'publisher' AS publisher,
  CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE 'CC' END AS license_name, 'https://license.example' AS license_url,
  CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_name END AS attribution_text, CASE WHEN s_suppkey % 13 = 0 THEN 0 ELSE 1 END AS allows_data_reuse,
  CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END AS requires_attribution, '1997-01-01' AS reviewed_at, CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE 1 END AS enabled
FROM supplier
""",
    "plan_sources": """
SELECT CAST(l_orderkey * 1000000 + l_suppkey AS BIGINT) AS id, l_orderkey AS plan_id, CAST(l_suppkey AS BIGINT) AS source_id,
  concat('r', CAST(l_orderkey AS STRING)) AS source_record_id, concat('https://source.example/', CAST(l_orderkey AS STRING)) AS source_url,
  CAST(NULL AS STRING) AS source_created_at, concat('1998-05-', CAST(10 + l_orderkey % 20 AS STRING)) AS source_updated_at,
  concat('{{"v":', CAST(l_orderkey % 10 AS STRING), '}}') AS source_payload_json, concat('1998-06-', CAST(10 + l_suppkey % 5 AS STRING)) AS imported_at,
  concat('1998-06-', CAST(10 + (l_orderkey + l_suppkey) % 6 AS STRING)) AS last_seen_at
FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_orderkey % 9 <> 0) t
""",
    "images": """
SELECT CAST(l_orderkey * 2000000 + l_suppkey * 2 + r.k AS BIGINT) AS id, CAST(l_orderkey * 1000000 + l_suppkey AS BIGINT) AS plan_source_id, r.role AS role,
  CASE WHEN (l_orderkey + r.k) % 9 = 0 THEN 'http://i.example/x' ELSE concat('https://i.example/', CAST(l_orderkey % 1000 AS STRING)) END AS url,
  CASE WHEN l_suppkey % 2 = 0 THEN '16_9' ELSE '4_3' END AS ratio, CAST(300 + (l_orderkey * 37) % 2000 AS INT) AS width, CAST(200 + (l_suppkey * 91) % 1900 AS INT) AS height,
  CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 0 END AS is_fallback, CASE WHEN l_orderkey % 2 = 0 THEN '' ELSE 'by x' END AS attribution,
  CASE WHEN l_orderkey % 8 = 4 THEN NULL ELSE concat('1998-06-', CAST(10 + (l_orderkey + l_suppkey) % 6 AS STRING)) END AS last_seen_at, '1998-01-01' AS created_at, '1998-01-01' AS updated_at
FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_orderkey % 9 <> 0) t
JOIN (SELECT 0 AS k, 'card' AS role UNION ALL SELECT 1 AS k, 'detail' AS role) r ON r.k = 0 OR l_orderkey % 20 <> 0
""",
    "feed": """
SELECT event_id AS pos, CAST(event_id AS STRING) AS event_id,
  CASE WHEN event_id % 50 = 7 THEN concat(event_type, ' | Paquetes VIP') WHEN event_id % 50 = 9 THEN concat('Upgrade ', event_type) ELSE concat('El ', event_type) END AS title,
  CASE WHEN event_id % 6 = 0 THEN 'universe' WHEN event_id % 6 = 1 THEN 'mfx-external' WHEN event_id % 31 = 0 THEN 'else' WHEN event_id % 2 = 0 THEN 'trium' ELSE 'mfx-es' END AS source,
  event_id % 17 <> 0 AS official_seller, CASE WHEN event_id % 23 = 0 THEN 'Other' WHEN event_id % 29 <> 0 THEN 'Box' END AS brand_name,
  CASE WHEN event_id % 4 = 0 THEN CAST(CASE WHEN user_id % 10 < 4 THEN user_id % 10 ELSE user_id END AS STRING) ELSE '' END AS venue_id,
  concat('Sala ', CAST(CASE WHEN user_id % 10 < 4 THEN user_id % 10 ELSE user_id END AS STRING)) AS venue_name,
  'Girona' AS municipality, CASE WHEN event_id % 8 = 3 THEN 'Gerona' WHEN event_id % 8 = 5 THEN 'Elsewhere' ELSE 'Girona' END AS state,
  CASE WHEN event_id % 15 = 0 THEN 'FR' ELSE 'es' END AS country, CASE WHEN event_id % 9 = 0 THEN '17001' ELSE '99001' END AS postal_code,
  CASE WHEN event_id % 12 = 5 THEN NULL WHEN event_id % 12 = 7 THEN CAST(50 AS DOUBLE) ELSE CAST(42 AS DOUBLE) END AS latitude, CAST(2.5 AS DOUBLE) AS longitude,
  {event_day} AS start_date, CASE WHEN event_id % 10 = 0 THEN '2024-02-01' ELSE {event_day} END AS end_date, {event_time} AS start_time, value, props
FROM events
""",
}


_SQL["agenda"] = """
SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 37 = 0 THEN '' ELSE concat('c', CAST(o_orderkey AS STRING)) END AS codi, CASE WHEN o_orderkey % 31 = 0 THEN '  ' WHEN o_orderkey % 29 = 0 THEN NULL ELSE concat(n_name, ' de la ', CAST(o_orderkey % 900 AS STRING)) END AS denominaci,
  CASE WHEN o_orderkey % 19 = 0 THEN ' ' WHEN o_orderkey % 3 = 0 THEN concat('Text of ', o_orderpriority) END AS descripcio, concat('<b>', c_name, '</b> &amp; ', o_orderpriority) AS subt_tol,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN 'soon' ELSE {day_start} || 'T00:00:00.000' END AS data_inici,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 101 = 0 THEN '2031-02-30' WHEN o_orderkey % 103 = 0 THEN '2031-01-31' ELSE {day_end} || 'T00:00:00.000' END AS data_fi,
  CASE WHEN o_orderkey % 9 = 0 THEN 'De 10 a&nbsp;12 <br/> h' WHEN o_orderkey % 9 = 1 THEN '<p> </p>' END AS horari,
  CASE WHEN o_orderkey % 4 = 0 THEN 'agenda:ambits/Jazz' WHEN o_orderkey % 4 = 1 THEN 'Dansa, Familiar' END AS tags_mbits, CASE WHEN o_orderkey % 6 = 0 THEN 'agenda:categories/museus' END AS tags_categor_es,
  concat('agenda:ubicacions/', lower(replace(r_name, ' ', '-')), '/', lower(replace(n_name, ' ', '-')), CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 7 = 1 THEN '/l-hospitalet-de-llobregat' WHEN o_orderkey % 7 = 2 THEN '/castell-d-aro' ELSE concat('/sant-', lower(c_mktsegment), '-de-les-abadesses') END) AS municipi,
  CASE WHEN o_orderkey % 23 = 0 THEN 'x' WHEN o_orderkey % 23 = 1 THEN '95.5' WHEN o_orderkey % 23 = 2 THEN '' ELSE concat('41.', CAST(o_orderkey % 100 AS STRING)) END AS latitud, CASE WHEN o_orderkey % 17 = 0 THEN '1d' ELSE concat(' +2.', CAST(o_orderkey % 70 AS STRING)) END AS longitud,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Sí' WHEN o_orderkey % 5 = 1 THEN ' NO ' WHEN o_orderkey % 5 = 2 THEN 'maybe' END AS gratuita, CASE WHEN o_orderkey % 41 = 0 THEN 'Sí' WHEN o_orderkey % 2 = 0 THEN 'no' END AS permanent,
  CASE WHEN o_orderkey % 8 = 0 THEN 'ftp://x.example/a' WHEN o_orderkey % 8 = 1 THEN 'https://a.example/1' END AS urlactivitat, CASE WHEN o_orderkey % 3 = 1 THEN 'http://b.example/2' ELSE 'none' END AS url,
  CASE WHEN o_orderkey % 10 = 0 THEN 'https://t.example/x' ELSE 'mailto:a' END AS linkbotoentrades, concat('<p>a</p><img src="x', CAST(o_orderkey % 9 AS STRING), '">b') AS descripcio_html, 'https://img.example/1' AS imatges
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_orderkey) ship ON l_orderkey = o_orderkey
"""
_SQL["feed_records"] = """
SELECT event_id AS pos, CAST(event_id AS STRING) AS event_id, CASE WHEN event_id % 3 = 0 THEN event_type END AS v_venue_name, concat('N', event_type) AS v_name, CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN 'ES' END AS v_country,
  CASE WHEN event_id % 8 = 2 THEN 'FR' END AS v_venue_country, 'PT' AS country_code, CASE WHEN event_id % 5 = 0 THEN 'Girona' END AS v_state, CASE WHEN event_id % 2 = 0 THEN 'Lleida' END AS v_state_name,
  CASE WHEN event_id % 6 = 0 THEN 'Olot' END AS v_city_name, CASE WHEN event_id % 7 = 0 THEN 'Reus' END AS v_venue_city, CASE WHEN event_id % 9 = 0 THEN CAST(42 AS DOUBLE) END AS v_lat, CASE WHEN event_id % 2 = 1 THEN CAST(41 AS DOUBLE) END AS v_venue_lat,
  {event_day} AS first_day, CASE WHEN event_id % 10 = 0 THEN '2024-02-01' END AS last_day FROM events
"""
RECORD_SQL = ("agenda", "feed_records")

# The same plans for Spark, with the documents joined last: rows move without their texts until then, and afterwards
# those of one document lie together (a merge join sorts them), so what is written or moved next packs well.
_TITLED = """
  SELECT o.*, split_part(coalesce(d.text, ''), chr(10), 1) AS title, coalesce(d.text, '') AS body
  FROM orders o CROSS JOIN many JOIN documents d ON d.doc_id = o.o_orderkey % many.n)"""
_AROUND = " JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey LEFT JOIN ship ON l_orderkey = o_orderkey"
_LATE = f"""
  SELECT /*+ MERGE(d) */ o.*, d.title, d.body
  FROM (SELECT b.*, c_name, c_mktsegment, n_name, r_name, last_ship FROM orders b{_AROUND}) o CROSS JOIN many
  JOIN (SELECT doc_id, split_part(coalesce(text, ''), chr(10), 1) AS title, coalesce(text, '') AS body FROM documents) d ON d.doc_id = o.o_orderkey % many.n)"""
_SPARK = {"plans": _SQL["plans"].replace(f"FROM titled{_AROUND}", "FROM titled").replace(_TITLED, _LATE)}


def relation_sql(name: str, engine: str) -> str:
    day, time = _DAY[engine].format, _TIME[engine].format
    return (_SPARK if engine == "spark" else {}).get(name, _SQL[name]).format(day_start=day("o_orderdate"), day_end=day("last_ship"), event_day=day("ts"), event_time=time("ts"))


_TABLES = {
    "plans": ["orders", "lineitem", "documents", "customer", "nation", "region"], "categories": ["part"], "plan_categories": ["lineitem", "part"],
    "sources": ["supplier"], "plan_sources": ["lineitem"], "images": ["lineitem"], "feed": ["events"],
    "agenda": ["orders", "lineitem", "customer", "nation", "region"], "feed_records": ["events"],
}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A catalogue relation over the tables in ``sf_dir``; its views have names of their own."""
    sql = relation_sql(name, "spark")
    for table in _TABLES[name]:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(f"eventide_{table}")
        sql = re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 eventide_{table}", sql)
    return spark.sql(sql)
