"""Registered queries of the feed's import, over a catalogue that already has part of the feed, with independent SQL.

The catalogue is made from the feed's own rows by rules on their place: plans that an earlier import left, with
the same payload or another; plans without a link that have a group's fingerprint; and plans of the agenda that are the same
event, or might be.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as X
from .operators import feed as feeds
from .operators import feed_import, normalize
from .plans.schemas import TABLES, seeded_categories
from .queries import BRAND, BUCKET, CONFIRMED, HORIZON, KEYS, k, nc, query, tk

JANUARY = datetime(2024, 1, 2, 12, tzinfo=timezone.utc)
STAMP = "2024-01-02T12:00:00.000Z"
POLICY = feeds.Policy(BRAND, denied=("369", "387"), recurring=feeds.Recurring(sessions=50, per_day=2, multi_share=0.5))
DENIED = ", ".join(f"'{i}'" for i in POLICY.denied)

CLASSES = "CASE pos % 6 WHEN 0 THEN 'Pop Music' WHEN 1 THEN 'Arts & Theatre' WHEN 2 THEN 'Film FAMILY' WHEN 3 THEN 'Música Infantil' ELSE '' END"
NAMED = "CASE WHEN pos % 43 = 5 THEN '' WHEN pos % 47 = 7 THEN ' ' WHEN pos % 10 = 4 THEN title || ' Music Hall' ELSE title END"
FEED_FULL = f"""SELECT feed.* REPLACE ({NAMED} AS title, CASE WHEN pos % 41 = 3 THEN 'soon' ELSE start_date END AS start_date), {CLASSES} AS classes, CASE WHEN pos % 4 = 0 THEN 'Info' WHEN pos % 4 = 1 THEN '  ' END AS info,
  CASE WHEN pos % 5 = 0 THEN 'https://t.example/' || pos ELSE 'mailto:x' END AS url, CASE pos % 8 WHEN 0 THEN '10 EUR' WHEN 1 THEN ' ' END AS price, 'Girona' AS province,
  CASE WHEN pos % 6 = 0 THEN 'C. Major 1' END AS address, CASE WHEN pos % 7 = 0 THEN 'cancelled' ELSE 'onsale' END AS event_status,
  '{{"eventId":"' || event_id || '","n":' || pos % 13 || ',"venue":{{"city":"Girona"}}}}' AS payload FROM feed"""


def feed_full(r) -> DataFrame:
    """The feed with all fields of a record; ``record`` has image fields at two depths."""
    c = F.col
    text = F.concat(F.lit('{"venue":{"image":{"u":[1,{"images":2}]},"city":"Girona"},"images":[{"url":"x"}],"n":'), (c("pos") % 13).cast("string"), F.lit(',"eventId":"'), c("event_id"), F.lit('"}'))
    which = c("pos") % 6
    return r("feed").withColumns({
        "title": F.when(c("pos") % 43 == 5, "").when(c("pos") % 47 == 7, " ").when(c("pos") % 10 == 4, F.concat("title", F.lit(" Music Hall"))).otherwise(c("title")),
        "start_date": F.when(c("pos") % 41 == 3, "soon").otherwise(c("start_date")), "record": F.parse_json(text),
        "classes": F.when(which == 0, "Pop Music").when(which == 1, "Arts & Theatre").when(which == 2, "Film FAMILY").when(which == 3, "Música Infantil").otherwise(""),
        "info": F.when(c("pos") % 4 == 0, "Info").when(c("pos") % 4 == 1, "  "), "url": F.when(c("pos") % 5 == 0, F.concat(F.lit("https://t.example/"), c("pos").cast("string"))).otherwise("mailto:x"),
        "price": F.when(c("pos") % 8 == 0, "10 EUR").when(c("pos") % 8 == 1, " "), "address": F.when(c("pos") % 6 == 0, "C. Major 1"), "event_status": F.when(c("pos") % 7 == 0, "cancelled").otherwise("onsale"),
    })


# ---- groups and their plans ------------------------------------------------------------------

SLUGS = "list_filter([CASE WHEN regexp_matches(c, 'music|música') THEN 'musica' END, CASE WHEN regexp_matches(c, 'arts|theatre') THEN 'espectacles' END, CASE WHEN regexp_matches(c, 'film') THEN 'cultura' END, CASE WHEN regexp_matches(c, 'family|infantil') THEN 'familia' END], lambda x: x IS NOT NULL)"
#: Of ``rows`` with keys: one row for each group, with the fields of its plan.
GROUPS = f"""SELECT *, 'feed|' || {tk("title")} || '|' || {k("municipality")} || '|' || {k("venue_name")} || '|' || start_date AS fingerprint, CASE WHEN list_contains(slugs, 'familia') THEN 1 END AS family,
    CAST(least(100, 30 + CASE WHEN raw_info <> '' THEN 15 ELSE 0 END + 10 + CASE WHEN latitude IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN address <> '' THEN 5 ELSE 0 END + 10 + CASE WHEN len(slugs) > 0 THEN 5 ELSE 0 END) AS INT) AS quality
  FROM (SELECT *, {SLUGS} AS slugs, CASE WHEN regexp_matches(raw_info, '[^\\s]') THEN raw_info END AS description, CASE WHEN regexp_matches(raw_price, '[^\\s]') THEN raw_price END AS price, CASE WHEN starts_with(raw_url, 'https:') THEN raw_url END AS tickets FROM (
    SELECT title_k, venue_k, place_k, start_date, min(pos) AS group_id, count(*) AS records, max(end_date) AS end_date, nullif(array_to_string(list_sort(list(DISTINCT nullif(start_time, ''))), ', '), '') AS schedule,
      arg_min(title, pos) AS title, arg_min(venue_name, pos) AS venue_name, arg_min(municipality, pos) AS municipality, (list(latitude ORDER BY pos))[1] AS latitude, (list(longitude ORDER BY pos))[1] AS longitude, (list(address ORDER BY pos))[1] AS address,
      (list(info ORDER BY pos))[1] AS raw_info, (list(price ORDER BY pos))[1] AS raw_price, arg_min(url, pos) AS raw_url, lower((list(classes ORDER BY pos))[1]) AS c, CASE arg_min(event_status, pos) WHEN 'cancelled' THEN 'cancelled' ELSE 'active' END AS status
    FROM rows GROUP BY title_k, venue_k, place_k, start_date) g WHERE regexp_matches(title, '[^\\s]')) h"""
SHOWN = "group_id, records, title AS original_title, title AS title_ca, title AS title_es, description AS original_description, description AS description_ca, description AS description_es, start_date, end_date, schedule AS schedule_text, price AS price_text, municipality, municipality AS locality, address, venue_name, latitude, longitude, tickets AS ticket_url, array_to_string(slugs, ',') AS slugs, family AS family_friendly, status, quality AS quality_score, fingerprint"


@query(f", full_feed AS ({FEED_FULL}), rows AS (SELECT *, {KEYS} FROM full_feed) SELECT {SHOWN} FROM ({GROUPS}) p", "feed")
def feed_group_plans(r):
    """All plan fields of each group of the whole feed."""
    rows = normalize.feed_plans(feeds.with_groups(feed_full(r).withColumn("province", F.lit("Girona"))))
    names = [n.split(" AS ")[-1] for n in SHOWN.split(", ") if not n.startswith(("array_to_string", "'"))]
    return rows.withColumn("slugs", F.array_join("category_slugs", ",")).select(*[n for n in names if not n.endswith(("')", "slugs"))], "slugs")


@query(f"SELECT event_id, payload FROM ({FEED_FULL}) f", "feed")
def feed_payloads(r):
    """Whole records as canonical JSON, without image fields at any depth."""
    return feed_full(r).select("event_id", normalize.feed_payload(F.col("record")).alias("payload"))


# ---- the import ------------------------------------------------------------------------------

WITHIN = HORIZON.replace("2024-01-05", "2024-01-02").replace("2024-01-25", "2024-02-01")
REPORT = f"""SELECT *, {BUCKET} AS bucket, CASE WHEN title = '' THEN 'invalid' ELSE {WITHIN} END AS dates, {CONFIRMED} AS inside, {KEYS} FROM full_feed"""
STEPS = f"""full_feed AS ({FEED_FULL}), report AS ({REPORT}),
candidates AS (SELECT * FROM report WHERE bucket = 'accepted' AND dates = 'accepted' AND inside),
inventory AS (SELECT title_k, venue_k, place_k FROM (SELECT title_k, venue_k, place_k, start_date, count(*) AS n FROM candidates GROUP BY ALL) d GROUP BY title_k, venue_k, place_k
  HAVING sum(n) >= 50 AND count(*) >= 21 AND date_diff('day', CAST(min(start_date) AS DATE), CAST(max(start_date) AS DATE)) + 1 >= 28 AND sum(n) / count(*) >= 2 AND count(*) FILTER (n > 1) / count(*) >= 0.5 AND count(*) / (date_diff('day', CAST(min(start_date) AS DATE), CAST(max(start_date) AS DATE)) + 1) >= 0.6),
rest AS (SELECT c.* FROM candidates c LEFT JOIN inventory i ON i.title_k = c.title_k AND i.venue_k = c.venue_k AND i.place_k = c.place_k WHERE i.title_k IS NULL),
variants AS (SELECT DISTINCT a.event_id FROM (SELECT *, contains(title, '| Paquetes VIP') AS vip, starts_with(title, 'Upgrade ') AS extra FROM rest) a JOIN rest b
  ON a.pos <> b.pos AND a.venue_k = b.venue_k AND a.place_k = b.place_k AND a.start_date = b.start_date AND a.venue_k <> ''
  WHERE (a.vip AND a.start_time = b.start_time AND {tk("replace(a.title, '| Paquetes VIP', '')")} = b.title_k)
    OR (a.extra AND (contains({tk("replace(a.title, 'Upgrade', ' ')")}, b.title_k) OR contains(b.title_k, {tk("replace(a.title, 'Upgrade', ' ')")})))),
rows AS (SELECT * FROM rest WHERE event_id NOT IN ({DENIED}) AND event_id NOT IN (SELECT event_id FROM variants)),
groups AS ({GROUPS}),
stored AS (
  SELECT pos + 1 AS id, CASE WHEN pos % 21 = 7 THEN 'feed|' || title_k || '|' || place_k || '|' || {k("venue_name")} || '|' || start_date ELSE 'old-' || pos END AS fingerprint, title, venue_name, municipality, start_date, end_date, latitude, longitude,
    CAST(NULL AS VARCHAR) AS address, CASE WHEN pos % 5 = 0 THEN 'old' END AS schedule, CASE WHEN pos % 9 = 0 THEN 'kept' END AS price, CASE WHEN pos % 12 = 9 OR pos % 30 = 3 THEN 'inactive' ELSE 'active' END AS status, CAST(50 AS INT) AS quality, CASE WHEN pos % 12 = 9 OR pos % 30 = 3 THEN '2024-01-01' END AS inactive_at
  FROM report WHERE pos % 3 = 0 OR pos % 21 = 7
  UNION ALL SELECT pos + 20000000, 'agenda-' || pos, title, CASE WHEN pos % 11 = 5 THEN venue_name ELSE 'Elsewhere' END, upper(municipality), start_date, end_date, 41, 2, NULL, NULL, NULL, 'active', 60, NULL FROM report WHERE pos % 11 IN (5, 6)),
links AS (SELECT pos + 1 AS id, pos + 1 AS plan_id, 8 AS source_id, event_id AS record_id, CASE WHEN pos % 4 = 1 THEN payload ELSE '{{"old":1}}' END AS payload FROM report WHERE pos % 3 = 0
  UNION ALL SELECT pos + 20000000, pos + 20000000, 5, 'a' || event_id, '{{}}' FROM report WHERE pos % 11 IN (5, 6)),
pairs AS (SELECT g.group_id, c.id AS c_id, {k("c.venue_name")} = {k("g.venue_name")} OR coalesce(abs(g.latitude - c.latitude) <= 0.002 AND abs(g.longitude - c.longitude) <= 0.002, false) AS sure
  FROM groups g JOIN stored c ON c.id > 20000000 AND c.start_date = g.start_date AND {nc("c.municipality")} = {nc("g.municipality")} AND {tk("c.title")} = {tk("g.title")}),
matches AS (SELECT group_id, any_value(target) AS target, count(*) FILTER (target IS NULL OR c_id < target) AS n_possible FROM (SELECT *, min(CASE WHEN sure THEN c_id END) OVER (PARTITION BY group_id) AS target FROM pairs) p GROUP BY group_id),
known AS (SELECT r.pos, r.event_id, r.payload, r.url, g.*, m.target, m.n_possible, l.plan_id AS known, l.payload AS old, (SELECT min(id) FROM stored s WHERE s.fingerprint = g.fingerprint) AS print, r.pos = g.group_id AS leads
  FROM rows r JOIN groups g ON g.title_k = r.title_k AND g.venue_k = r.venue_k AND g.place_k = r.place_k AND g.start_date = r.start_date
  LEFT JOIN matches m ON m.group_id = g.group_id LEFT JOIN links l ON l.source_id = 8 AND l.record_id = r.event_id),
fresh AS (SELECT fingerprint, min(pos) AS opened FROM known WHERE leads AND known IS NULL AND target IS NULL AND print IS NULL GROUP BY fingerprint),
ids AS (SELECT *, (SELECT max(id) FROM stored) + row_number() OVER (ORDER BY opened) AS new FROM fresh),
placed AS (SELECT k.*, i.opened, last_value(coalesce(known, CASE WHEN leads THEN coalesce(target, print, new) END) IGNORE NULLS) OVER (PARTITION BY group_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS plan_id FROM known k LEFT JOIN ids i ON i.fingerprint = k.fingerprint),
outcomes AS (SELECT *, CASE WHEN known IS NOT NULL AND payload = old THEN 'touch' WHEN leads AND known IS NULL AND target IS NULL AND print IS NULL AND pos = opened THEN 'insert' WHEN known IS NOT NULL AND leads AND target IS NULL THEN 'overwrite' ELSE 'fill' END AS action FROM placed),
live AS (SELECT * FROM (SELECT *, max(CASE WHEN action = 'overwrite' THEN pos END) OVER (PARTITION BY plan_id) AS since FROM outcomes WHERE action IN ('overwrite', 'fill')) o WHERE since IS NULL OR pos >= since),
folded AS (SELECT plan_id, max(since) IS NOT NULL AS over, (list(status ORDER BY pos) FILTER (action = 'overwrite'))[1] AS over_status, bool_or(status = 'active') AS any_active, max(quality) AS quality,
  arg_min(title, pos) AS title, arg_min(schedule, pos) FILTER (schedule IS NOT NULL) AS schedule, arg_min(price, pos) FILTER (price IS NOT NULL) AS price, arg_min(address, pos) FILTER (address IS NOT NULL) AS address, max(end_date) FILTER (true) AS any_end, arg_min(end_date, pos) AS end_date, arg_min(start_date, pos) AS start_date FROM live GROUP BY plan_id),
made AS (SELECT id, title, schedule, price, address, status, quality, inactive_at, start_date, end_date, FALSE AS new FROM stored
  UNION ALL SELECT plan_id, title, schedule, price, address, status, quality, NULL, start_date, end_date, TRUE FROM outcomes WHERE action = 'insert'),
merged AS (SELECT m.id, CASE WHEN over THEN f.title ELSE m.title END AS title, CASE WHEN over THEN f.schedule ELSE coalesce(m.schedule, f.schedule) END AS schedule, CASE WHEN over THEN f.price ELSE coalesce(m.price, f.price) END AS price,
    CASE WHEN over THEN f.address ELSE coalesce(m.address, f.address) END AS address, CASE WHEN over THEN f.start_date ELSE m.start_date END AS start_date, CASE WHEN over THEN f.end_date ELSE m.end_date END AS end_date,
    CASE WHEN over THEN f.quality ELSE greatest(m.quality, coalesce(f.quality, 0)) END AS quality, CASE WHEN any_active AND coalesce(over_status, m.status) = 'inactive' THEN 'active' ELSE coalesce(over_status, m.status) END AS status,
    CASE WHEN any_active THEN NULL ELSE inactive_at END AS inactive_at, m.new OR f.plan_id IS NOT NULL AS touched FROM made m LEFT JOIN folded f ON f.plan_id = m.id),
awake AS (SELECT m.* REPLACE (CASE WHEN s.plan_id IS NOT NULL AND status = 'inactive' THEN NULL ELSE inactive_at END AS inactive_at, touched OR (s.plan_id IS NOT NULL AND status = 'inactive') AS touched, CASE WHEN s.plan_id IS NOT NULL AND status = 'inactive' THEN 'active' ELSE status END AS status)
  FROM merged m LEFT JOIN (SELECT DISTINCT plan_id FROM outcomes WHERE action = 'touch' AND status = 'active') s ON s.plan_id = m.id),
linked AS (SELECT l.id, l.plan_id, source_id, l.record_id, coalesce(o.payload, l.payload) AS payload, CASE WHEN o.action <> 'touch' THEN o.url END AS url, o.pos IS NOT NULL AS seen, coalesce(o.action <> 'touch', FALSE) AS changed FROM links l LEFT JOIN outcomes o ON l.source_id = 8 AND o.event_id = l.record_id
  UNION ALL SELECT (SELECT max(id) FROM links) + row_number() OVER (ORDER BY pos), plan_id, 8, event_id, payload, url, TRUE, TRUE FROM outcomes WHERE known IS NULL),
lost AS (SELECT l.id, l.plan_id FROM linked l JOIN awake p ON p.id = l.plan_id WHERE source_id = 8 AND coalesce(end_date, start_date) >= '2024-01-02' AND start_date <= '2024-02-01' AND record_id NOT IN (SELECT event_id FROM report WHERE bucket = 'accepted')),
remaining AS (SELECT * FROM linked WHERE id NOT IN (SELECT id FROM lost))"""


def catalogue(r) -> dict[str, DataFrame]:
    """The state before the import: see the module's text."""
    c, feed = F.col, feed_full(r)
    spark = feed.sparkSession
    empty = {n: spark.createDataFrame([], s) for n, s in TABLES.items()}
    keyed = feeds.keyed(feed)
    own, agenda = keyed.where("pos % 3 = 0 OR pos % 21 = 7"), keyed.where("pos % 11 IN (5, 6)")
    none = F.lit(None).cast("string")
    shared = {"original_title": c("title"), "venue_name": c("venue_name"), "municipality": c("municipality"), "start_date": c("start_date"), "end_date": c("end_date"), "kind": F.lit("event"), "permanent": F.lit(0), "featured": F.lit(0), "image_reuse_allowed": F.lit(0)}
    print_ = F.concat_ws("|", F.lit("feed"), "title_k", "place_k", X.key(c("venue_name")), "start_date")
    mine = shared | {
        "id": c("pos") + 1, "fingerprint": F.when(c("pos") % 21 == 7, print_).otherwise(F.concat(F.lit("old-"), c("pos").cast("string"))), "latitude": c("latitude"), "longitude": c("longitude"), "schedule_text": F.when(c("pos") % 5 == 0, "old"),
        "price_text": F.when(c("pos") % 9 == 0, "kept"), "status": F.when((c("pos") % 12 == 9) | (c("pos") % 30 == 3), "inactive").otherwise("active"), "quality_score": F.lit(50), "inactive_at": F.when((c("pos") % 12 == 9) | (c("pos") % 30 == 3), "2024-01-01"),
    }
    theirs = shared | {
        "id": c("pos") + 20_000_000, "fingerprint": F.concat(F.lit("agenda-"), c("pos").cast("string")), "venue_name": F.when(c("pos") % 11 == 5, c("venue_name")).otherwise("Elsewhere"), "municipality": F.upper("municipality"),
        "latitude": F.lit(41.0), "longitude": F.lit(2.0), "status": F.lit("active"), "quality_score": F.lit(60),
    }
    whole = lambda rows, values, name: rows.select(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in empty[name].schema))
    payload = F.when(c("pos") % 4 == 1, normalize.feed_payload(c("record"))).otherwise('{"old":1}')
    link = {"id": c("pos") + 1, "plan_id": c("pos") + 1, "source_id": F.lit(8), "source_record_id": c("event_id"), "source_payload_json": payload, "source_url": none}
    other = {"id": c("pos") + 20_000_000, "plan_id": c("pos") + 20_000_000, "source_id": F.lit(5), "source_record_id": F.concat(F.lit("a"), "event_id"), "source_payload_json": F.lit("{}")}
    return empty | {
        "plans": whole(own, mine, "plans").union(whole(agenda, theirs, "plans")), "plan_sources": whole(own.where("pos % 3 = 0"), link, "plan_sources").union(whole(agenda, other, "plan_sources")),
        "sources": r("sources").where("id IN (5, 8)"), "categories": seeded_categories(spark),
    }


def imported(r, dry_run: bool = False):
    return feed_import.import_feed(feed_full(r).withColumn("province", F.lit(None).cast("string")), catalogue(r), JANUARY, POLICY, 8, 30, "agenda", dry_run)


FUNNEL = f"""count(*) AS records, count(*) FILTER (bucket = 'accepted') AS accepted, count(*) FILTER (bucket = 'accepted' AND source = 'trium') AS accepted_trium, count(*) FILTER (bucket = 'accepted' AND source = 'mfx-es') AS accepted_mfx_es,
    count(*) FILTER (bucket = 'universe') AS excluded_universe, count(*) FILTER (bucket = 'mfx-external') AS excluded_mfx_external, count(*) FILTER (bucket = 'other') AS excluded_other,
    count(*) FILTER (bucket = 'accepted' AND dates = 'accepted') AS within_horizon, (SELECT count(*) FROM candidates) AS candidates, count(*) FILTER (bucket = 'accepted' AND dates = 'accepted' AND NOT coalesce(inside, false)) AS outside,
    count(*) FILTER (bucket = 'accepted' AND dates = 'out') AS out_of_horizon, (SELECT count(*) FROM candidates) - (SELECT count(*) FROM rest) AS recurring, (SELECT count(*) FROM variants WHERE event_id NOT IN ({DENIED})) AS variants,
    (SELECT count(*) FROM rest WHERE event_id IN ({DENIED})) AS denied, count(*) FILTER (bucket = 'accepted' AND dates = 'invalid') + (SELECT count(*) FROM rows WHERE title = ' ') AS invalid"""
MERGES = "(SELECT count(*) FROM matches WHERE target IS NOT NULL) AS confirmed_merges, (SELECT count(*) FROM matches WHERE n_possible > 0) AS possible_merges"


def _counters(r, dry_run: bool) -> DataFrame:
    n = imported(r, dry_run)[1]
    return r("feed").sparkSession.createDataFrame([tuple(n.values())], ", ".join(f"{c} long" for c in n))


@query(
    f""", {STEPS} SELECT {FUNNEL}, (SELECT count(*) FROM outcomes WHERE leads AND action = 'insert') AS new_plans, (SELECT count(*) FROM outcomes WHERE leads AND action IN ('overwrite', 'fill')) AS updates,
    (SELECT count(*) FROM outcomes WHERE leads AND action = 'touch') AS unchanged, {MERGES}, (SELECT count(*) FROM lost) AS removals FROM report""",
    "feed",
)
def feed_import_counters(r):
    """The 21 counters of a real import, observed on its own passes."""
    return _counters(r, False)


@query(
    f""", {STEPS}, held AS (SELECT group_id, bool_or(known IS NOT NULL) AS held, any_value(target) AS target FROM known GROUP BY group_id) SELECT {FUNNEL}, (SELECT count(*) FROM held WHERE NOT held AND target IS NULL) AS new_plans,
    (SELECT count(*) FROM held WHERE held) AS updates, 0 AS unchanged, {MERGES}, (SELECT count(*) FROM links l JOIN stored p ON p.id = l.plan_id WHERE source_id = 8 AND coalesce(end_date, start_date) >= '2024-01-02' AND start_date <= '2024-02-01'
      AND record_id NOT IN (SELECT event_id FROM report WHERE bucket = 'accepted')) AS removals FROM report""",
    "feed",
)
def feed_import_report(r):
    """The counters of a dry run, which changes nothing."""
    return _counters(r, True)


@query(
    f""", {STEPS} SELECT p.id, title, schedule AS schedule_text, price AS price_text, address, end_date, quality AS quality_score, CASE WHEN l.plan_id IS NULL THEN status WHEN n > 0 THEN CASE WHEN status = 'inactive' THEN 'active' ELSE status END ELSE 'inactive' END AS status,
    CASE WHEN l.plan_id IS NULL THEN inactive_at WHEN coalesce(n, 0) = 0 THEN '{STAMP}' END AS inactive_at, touched OR (l.plan_id IS NOT NULL AND (coalesce(n, 0) = 0 OR status = 'inactive' OR inactive_at IS NOT NULL)) AS touched
    FROM awake p LEFT JOIN (SELECT DISTINCT plan_id FROM lost) l ON l.plan_id = p.id LEFT JOIN (SELECT plan_id, count(*) AS n FROM remaining GROUP BY plan_id) r ON r.plan_id = p.id""",
    "feed",
)
def feed_import_plans(r):
    """The plans after the import: overwritten, filled, new, woken and put to sleep."""
    after = imported(r)[0]["plans"]
    return after.select("id", F.col("original_title").alias("title"), "schedule_text", "price_text", "address", "end_date", "quality_score", "status", "inactive_at", F.coalesce(F.col("updated_at") == STAMP, F.lit(False)).alias("touched"))


@query(f", {STEPS} SELECT id, plan_id, source_id, record_id AS source_record_id, payload, url AS source_url, seen, changed FROM remaining", "feed")
def feed_import_links(r):
    """The links after the import, with the plans that they lead to."""
    after = imported(r)[0]["plan_sources"]
    is_now = lambda c: F.coalesce(F.col(c) == STAMP, F.lit(False))
    return after.select("id", "plan_id", "source_id", "source_record_id", F.col("source_payload_json").alias("payload"), "source_url", is_now("last_seen_at").alias("seen"), is_now("imported_at").alias("changed"))
