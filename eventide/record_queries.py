"""Registered queries of records, imports, state and presentation, each with an independent SQL form.

They use the relations of ``testdata`` and some more that are built here from the same tables.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import clock
from .functions import text as X
from .functions.session import settled, shared_folder
from .operators import feed as feeds
from .operators import jobs, normalize, predicates, present, search, state
from .operators.search import Filters
from .plans.schemas import AGENDA_FIELDS, CATEGORY_ROWS, TABLES, seeded_categories
from .queries import FOUND, GOOD_IMAGE, ISSUE, KEYS, LAST, ORDERS, OUTCOMES, OUTSIDE, QUERIES, RETAINED, TITLE, TODAY, _incoming, k, nc, plain, query, ranked, shown, tk
from .sources import readers
from .sources.ledger import RunLedger
from .sources.snapshot import read_snapshot, remove_folder, write_snapshot
from .testdata import NOW, RECORD_SQL  # noqa: F401

STAMP = "1998-06-15T12:00:00.000Z"


# ---- records ---------------------------------------------------------------------------------


def blank(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '[^\\s]') THEN {c} END"


def iso(c: str) -> str:
    return f"nullif(regexp_extract({c}, '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1), '')"


def yes(c: str) -> str:
    return f"CASE WHEN lower(trim(strip_accents({c}))) IN ('si', 'yes', 'true', '1') THEN 1 WHEN lower(trim(strip_accents({c}))) IN ('no', 'false', '0') THEN 0 END"


def number(c: str, most: int) -> str:
    return f"CASE WHEN regexp_full_match(trim({c}), '[+-]?[0-9]+(\\.[0-9]*)?') AND abs(CAST(trim({c}) AS DOUBLE)) <= {most} THEN CAST(trim({c}) AS DOUBLE) END"


def url(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '^https?://') THEN {c} END"


def named(slug: str) -> str:
    words = f"list_transform(string_split({slug}, '-'), lambda w, i: CASE WHEN i > 1 AND w IN ('de', 'del', 'dels', 'i', 'la', 'les') THEN w ELSE upper(w[1]) || w[2:] END)"
    return f"nullif(regexp_replace(array_to_string({words}, ' '), '\\b([DL]) ([AEIOUH])', '\\1''\\2', 'g'), '')"


def place(n: int) -> str:
    return named(f"string_split(substr(municipi, 19), '/')[{n}]")


TAGS = "lower(strip_accents(concat_ws(' ', tags_mbits, tags_categor_es)))"
SLUGS = f"list_filter([CASE WHEN contains({TAGS}, 'familiar') THEN 'familia' END, CASE WHEN contains({TAGS}, 'jazz') THEN 'musica' END, CASE WHEN contains({TAGS}, 'dansa') THEN 'espectacles' END, CASE WHEN contains({TAGS}, 'museus') THEN 'museus' END], lambda x: x IS NOT NULL)"
STRIPPED = "nullif(trim(regexp_replace(replace(replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')), '')"
AGENDA_PLANS = f"""SELECT codi AS code, denominaci AS title, {blank("descripcio")} AS description, {iso("data_inici")} AS start_date, {iso("data_fi")} AS end_date,
  coalesce({yes("permanent")}, 0) AS permanent, {yes("gratuita")} AS is_free, {STRIPPED.format("subt_tol")} AS subtitle, {STRIPPED.format("horari")} AS schedule,
  {place(1)} AS province, {place(2)} AS comarca, {place(3)} AS municipality, {number("latitud", 90)} AS latitude, {number("longitud", 180)} AS longitude,
  coalesce({url("urlactivitat")}, {url("url")}) AS website, {url("linkbotoentrades")} AS tickets, array_to_string({SLUGS}, ',') AS slugs
  FROM agenda WHERE coalesce(codi, '') <> '' AND regexp_matches(denominaci, '[^\\s]')"""


def agenda(r) -> DataFrame:
    """The agenda relation with all fields of a record."""
    rows = r("agenda")
    return rows.select(*rows.columns, *(F.lit(None).cast("string").alias(f) for f in AGENDA_FIELDS if f not in rows.columns))


@query(
    f"""SELECT *, {tk("title")} || '|' || {k("municipality")} || '|' || coalesce(start_date, CASE WHEN permanent = 1 THEN 'permanent' ELSE 'sense-data' END) AS fingerprint,
    CAST(least(100, 20 + CASE WHEN description IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN start_date IS NOT NULL OR permanent = 1 THEN 10 ELSE 0 END + CASE WHEN municipality IS NOT NULL THEN 10 ELSE 0 END
      + CASE WHEN comarca IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN website IS NOT NULL THEN 10 ELSE 0 END
      + CASE WHEN is_free IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN schedule IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN slugs <> '' THEN 5 ELSE 0 END) AS INT) AS quality FROM ({AGENDA_PLANS}) a""",
    "agenda",
)
def agenda_record_plans(r):
    rows = normalize.agenda_plans(normalize.without_restricted_images(agenda(r)))
    return rows.select(
        "code", F.col("original_title").alias("title"), F.col("original_description").alias("description"), "start_date", "end_date", "permanent", "is_free", F.col("subtitle_ca").alias("subtitle"),
        F.col("schedule_text").alias("schedule"), "province", "comarca", "municipality", "latitude", "longitude", F.col("website_url").alias("website"), F.col("ticket_url").alias("tickets"),
        F.array_join("category_slugs", ",").alias("slugs"), "fingerprint", F.col("quality_score").alias("quality"),
    )


@query("SELECT codi FROM agenda WHERE data_fi >= '1998-06-15' OR (data_fi IS NULL AND data_inici >= '1998-06-15') OR lower(permanent) IN ('si', 'sí')", "agenda")
def agenda_wanted(r):
    return readers.current_agenda(agenda(r), "1998-06-15").select("codi")


@query("SELECT codi, regexp_replace(coalesce(descripcio_html, ''), '<img[^>]*>', '', 'g') AS html, FALSE AS has_images FROM agenda", "agenda")
def agenda_without_images(r):
    rows = normalize.without_restricted_images(agenda(r))
    return rows.select("codi", F.coalesce("descripcio_html", F.lit("")).alias("html"), F.lit(any(c in rows.columns for c in normalize.RESTRICTED)).alias("has_images"))


@query(
    """SELECT event_id, coalesce(v_venue_name, v_name) AS venue_name, coalesce(nullif(coalesce(v_country, v_venue_country), ''), country_code) AS country, coalesce(v_state, v_state_name) AS state,
    coalesce(v_city_name, v_venue_city) AS municipality, coalesce(v_lat, v_venue_lat) AS latitude, coalesce(last_day, first_day) AS end_date, CASE WHEN pos % 3 = 0 THEN 'Music x y' ELSE 'Music' END AS classes, pos % 2 = 0 AS official_seller, CASE WHEN pos % 4 <> 3 THEN 'Street 1' END AS address FROM feed_records""",
    "feed_records",
)
def feed_aliases(r):
    """Records as variants, with what is missing left out; some have a class as an object, an address as one, and a seller's mark as text."""
    c = F.col
    names = {
        "venueName": "v_venue_name", "name": "v_name", "countryCode": "v_country", "venueCountryCode": "v_venue_country", "state": "v_state", "stateName": "v_state_name",
        "cityName": "v_city_name", "venueCity": "v_venue_city", "lat": "v_lat", "venueLatitude": "v_venue_lat",
    }
    which = c("pos") % 4
    address = F.when(which == 0, F.parse_json(F.lit('{"line1":"Street 1"}'))).when(which == 3, F.parse_json(F.lit("[1]"))).otherwise(F.parse_json(F.lit('"Street 1"')))
    genre = F.when(c("pos") % 3 == 0, F.parse_json(F.lit('{"a":"x","b":"y"}')))
    seller = F.when(c("pos") % 2 == 0, F.parse_json(F.lit("true"))).otherwise(F.parse_json(F.lit('"true"')))
    record = F.struct(
        c("event_id").alias("eventId"), c("first_day").alias("eventStartLocalDate"), c("last_day").alias("eventEndLocalDate"), c("country_code").alias("countryCode"), F.lit("Music").alias("segmentName"), genre.alias("genreName"), seller.alias("officialSeller"),
        F.struct(*(c(v).alias(n) for n, v in names.items()), address.alias("address")).alias("venue"),
    )
    rows = readers.flatten_feed(r("feed_records").select("pos", F.parse_json(F.to_json(record)).alias("record")))
    order = F.when(c("classes") == "x y Music", "Music x y").otherwise(c("classes"))
    return rows.select("event_id", "venue_name", "country", "state", "municipality", c("latitude").cast("double").alias("latitude"), "end_date", order.alias("classes"), "official_seller", "address")


@query(
    """SELECT event_id, '{"a":[' || event_id || ',{"k":' || pos % 7 || ',"z":"x"}],"b":{"c":null,"d":"é"}}' AS canonical FROM feed""",
    "feed",
)
def canonical_nested(r):
    messy = F.concat(F.lit('{ "b" : {"d":"é", "c" :null}, "a": [ '), F.col("event_id"), F.lit(', {"z":"x", "k":'), (F.col("pos") % 7).cast("string"), F.lit("}] }"))
    return r("feed").select("event_id", X.canonical_json(messy).alias("canonical"))


SEEDS = ", ".join(f"({i}, '{slug}', '{icon}')" for i, (slug, *_, icon) in enumerate(CATEGORY_ROWS, 1))
HELD = "SELECT id, CASE id WHEN 2 THEN 'musica' WHEN 4 THEN 'natura' ELSE slug END AS slug, icon FROM categories"


@query(
    f"""SELECT id, slug, icon FROM ({HELD}) h WHERE slug NOT IN (SELECT slug FROM (VALUES {SEEDS}) t(pos, slug, icon))
    UNION ALL SELECT coalesce(h.id, (SELECT max(id) FROM categories) + pos), t.slug, t.icon FROM (VALUES {SEEDS}) t(pos, slug, icon) LEFT JOIN ({HELD}) h ON h.slug = t.slug""",
    "categories",
)
def seeded_dimension(r):
    """The seed over stored categories, two of which it knows."""
    rows = r("categories")
    slug = F.when(F.col("id") == 2, "musica").when(F.col("id") == 4, "natura").otherwise(F.col("slug"))
    return seeded_categories(rows.sparkSession, rows.withColumn("slug", slug)).select("id", "slug", "icon")


# ---- sources ---------------------------------------------------------------------------------

REASON = """CASE WHEN enabled <> 1 THEN 'disabled' WHEN allows_data_reuse <> 1 THEN 'no reuse' WHEN license_name = '' THEN 'review incomplete'
  WHEN requires_attribution = 1 AND coalesce(attribution_text, '') = '' THEN 'attribution missing' END"""


@query(f"SELECT 'id' AS asked, id, {REASON} AS reason FROM sources WHERE id = 7 UNION ALL SELECT 'key', id, {REASON} FROM sources WHERE key = 's9' UNION ALL SELECT 'shared key', id, {REASON} FROM sources WHERE key = 'agenda'", "sources")
def source_lookup(r):
    asked = {"id": 7, "key": "s9", "shared key": "agenda"}
    found = [jobs.find_source(r("sources"), value).select(F.lit(name).alias("asked"), "id", "reason") for name, value in asked.items()]
    return found[0].union(found[1]).union(found[2])


@query(f"SELECT id, key, name, row_number() OVER (ORDER BY {nc('name')}, id) AS rank FROM sources WHERE enabled = 1", "sources")
def sources_by_name(r):
    return ranked(jobs.sources_listed(r("sources")).select("id", "key", "name"), X.nocase(F.col("name")), "id")


@query("SELECT id, slug, name_ca, row_number() OVER (ORDER BY slug) AS rank FROM categories", "categories")
def categories_by_slug(r):
    return ranked(jobs.categories_listed(r("categories")).select("id", "slug", "name_ca"), "slug")


# ---- state -----------------------------------------------------------------------------------

FOLDED = """SELECT fingerprint, min(id) AS target, arg_min(title_es, id) FILTER (title_es IS NOT NULL) AS title_es, arg_min(venue_name, id) FILTER (venue_name IS NOT NULL) AS venue_name,
  arg_min(latitude, id) FILTER (latitude IS NOT NULL) AS latitude, max(quality_score) AS quality_score, bool_or(status = 'active') AS any_active FROM plans GROUP BY fingerprint"""


@query(
    f"""SELECT p.id, coalesce(p.title_es, f.title_es) AS title_es, coalesce(p.venue_name, f.venue_name) AS venue_name, coalesce(p.latitude, f.latitude) AS latitude, greatest(p.quality_score, coalesce(f.quality_score, 0)) AS quality_score,
    CASE WHEN f.any_active AND p.status = 'inactive' THEN 'active' ELSE p.status END AS status, CASE WHEN coalesce(f.any_active, false) THEN NULL ELSE p.inactive_at END AS inactive_at,
    CASE WHEN f.target IS NULL THEN p.updated_at ELSE '{STAMP}' END AS updated_at FROM plans p LEFT JOIN ({FOLDED}) f ON f.target = p.id""",
    "plans",
)
def fill_plans(r):
    plans = r("plans")
    target = plans.groupBy("fingerprint").agg(F.min("id").alias("target"))
    folded = state.fold_fills(plans, "fingerprint", "id", ["title_es", "venue_name", "latitude"]).join(target, "fingerprint").withColumnRenamed("target", "id").drop("fingerprint")
    return state.fill(plans, folded, STAMP).select("id", "title_es", "venue_name", "latitude", "quality_score", "status", "inactive_at", "updated_at")


@query(
    f"""SELECT id, fingerprint, CASE WHEN id % 5 <> 0 THEN title_ca ELSE original_title END AS title_ca, CASE WHEN id % 5 <> 0 THEN status ELSE 'active' END AS status,
    CASE WHEN id % 5 = 0 THEN NULL ELSE inactive_at END AS inactive_at, CASE WHEN id % 5 = 0 THEN '{STAMP}' ELSE updated_at END AS updated_at FROM plans""",
    "plans",
)
def overwrite_plans(r):
    """Incoming are the plans themselves, those divisible by five with another title and status."""
    plans = r("plans")
    new = plans.where("id % 5 = 0").select("id", F.lit("other").alias("fingerprint"), F.col("original_title").alias("title_ca"), F.lit("active").alias("status"))
    return state.overwrite(plans, new, STAMP).select("id", "fingerprint", "title_ca", "status", "inactive_at", "updated_at")


@query(
    f"""SELECT p.id, CASE WHEN s.plan_id IS NOT NULL AND p.status = 'inactive' THEN 'active' ELSE p.status END AS status, CASE WHEN s.plan_id IS NOT NULL AND p.status = 'inactive' THEN NULL ELSE p.inactive_at END AS inactive_at,
    CASE WHEN s.plan_id IS NOT NULL AND p.status = 'inactive' THEN '{STAMP}' ELSE p.updated_at END AS updated_at FROM plans p LEFT JOIN (SELECT DISTINCT plan_id FROM plan_sources WHERE source_id = 7) s ON s.plan_id = p.id""",
    "plans", "plan_sources",
)
def reactivated_plans(r):
    seen = r("plan_sources").where("source_id = 7").select(F.col("plan_id").alias("id"))
    return state.reactivate(r("plans"), seen, STAMP).select("id", "status", "inactive_at", "updated_at")


@query(
    f"""SELECT ps.id, ps.plan_id, source_record_id, CASE WHEN o.pos IS NOT NULL AND o.payload <> source_payload_json THEN o.payload ELSE source_payload_json END AS payload,
      CASE WHEN o.pos IS NOT NULL AND o.payload <> source_payload_json THEN '{STAMP}' ELSE imported_at END AS imported_at, CASE WHEN o.pos IS NOT NULL THEN '{STAMP}' ELSE last_seen_at END AS last_seen_at
    FROM plan_sources ps LEFT JOIN outcomes o ON ps.source_id = 7 AND o.record_id = ps.source_record_id
    UNION ALL SELECT (SELECT max(id) FROM plan_sources) + row_number() OVER (ORDER BY pos), plan_id, record_id, payload, '{STAMP}', '{STAMP}'
    FROM outcomes WHERE record_id NOT IN (SELECT source_record_id FROM plan_sources WHERE source_id = 7)""".replace("outcomes", f"(SELECT o.*, i.payload FROM ({OUTCOMES}) o JOIN (SELECT id, '{{\"v\":' || (id % CASE WHEN id % 4 = 0 THEN 10 ELSE 7 END) || '}}' AS payload FROM plans) i ON i.id = o.pos)"),
    "plans", "plan_sources",
)
def provenance_merge(r):
    rows = state.upsert_outcomes(_incoming(r), r("plan_sources"), r("plans"), 7)
    after = state.merge_provenance(r("plan_sources"), rows, 7, STAMP)
    return after.select("id", "plan_id", "source_record_id", F.col("source_payload_json").alias("payload"), "imported_at", "last_seen_at")


@query(
    """SELECT 'image' AS relation, id, role AS value FROM images WHERE plan_source_id NOT IN (SELECT id FROM plan_sources WHERE source_id = 7)
    UNION ALL SELECT 'plan', p.id, CASE WHEN l.plan_id IS NULL THEN p.status WHEN rest.n > 0 THEN CASE WHEN p.status = 'inactive' THEN 'active' ELSE p.status END ELSE 'inactive' END
    FROM plans p LEFT JOIN (SELECT DISTINCT plan_id FROM plan_sources WHERE source_id = 7) l ON l.plan_id = p.id
    LEFT JOIN (SELECT plan_id, count(*) AS n FROM plan_sources WHERE source_id <> 7 GROUP BY plan_id) rest ON rest.plan_id = p.id""",
    "plans", "images", "plan_sources",
)
def images_after_removal(r):
    """The images and plans that are left when source 7 goes."""
    links = r("plan_sources")
    after = state.remove_links({"plans": r("plans"), "plan_sources": links, "images": r("images")}, links.where("source_id = 7").select("id", "plan_id"), STAMP)
    images = after["images"].select(F.lit("image").alias("relation"), "id", F.col("role").alias("value"))
    return images.union(after["plans"].select(F.lit("plan"), "id", "status"))


ELIGIBLE = "status = 'inactive' AND inactive_at IS NOT NULL AND inactive_at <= '1998-06-08T12:00:00.000Z' AND NOT EXISTS (SELECT 1 FROM plan_sources ps WHERE ps.plan_id = p.id)"


@query(
    f"SELECT 'plans' AS relation, p.id AS a, 0 AS b FROM plans p WHERE NOT ({ELIGIBLE}) UNION ALL SELECT 'plan_categories', plan_id, category_id FROM plan_categories WHERE plan_id NOT IN (SELECT p.id FROM plans p WHERE {ELIGIBLE})",
    "plans", "plan_sources", "plan_categories",
)
def purged_inactive(r):
    after, _ = state.purge_inactive({n: r(n) for n in ("plans", "plan_sources", "plan_categories")}, NOW)
    plans = after["plans"].select(F.lit("plans").alias("relation"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    return plans.union(after["plan_categories"].select(F.lit("plan_categories"), "plan_id", "category_id"))


@query("SELECT ps.id AS source_link_id, source_record_id, plan_id, coalesce(title_ca, title_es, original_title) AS plan_title, status AS plan_status FROM plan_sources ps JOIN plans p ON p.id = plan_id WHERE source_id = 7", "plans", "plan_sources")
def record_lookup(r):
    return state.find_record(r("plan_sources"), r("plans"), 7)


REMOVED = "(SELECT min(source_record_id) FROM plan_sources WHERE source_id = 7)"
SUPPORT = f"""WITH_L AS (SELECT DISTINCT plan_id FROM plan_sources WHERE source_id = 7 AND source_record_id = {REMOVED}),
  support AS (SELECT plan_id, count(*) AS n FROM plan_sources WHERE NOT (source_id = 7 AND source_record_id = {REMOVED}) GROUP BY plan_id)""".replace("WITH_L", "gone")


@query(
    f""", {SUPPORT} SELECT 'plan' AS relation, p.id, CASE WHEN l.plan_id IS NULL THEN p.status WHEN p.status = 'inactive' THEN 'active' ELSE p.status END AS value
    FROM plans p LEFT JOIN gone l ON l.plan_id = p.id LEFT JOIN support rest ON rest.plan_id = p.id WHERE l.plan_id IS NULL OR coalesce(rest.n, 0) > 0
    UNION ALL SELECT 'category', plan_id, CAST(category_id AS VARCHAR) FROM plan_categories WHERE plan_id NOT IN (SELECT l.plan_id FROM gone l LEFT JOIN support rest ON rest.plan_id = l.plan_id WHERE coalesce(rest.n, 0) = 0)
    UNION ALL SELECT 'link', id, CAST(plan_id AS VARCHAR) FROM plan_sources WHERE NOT (source_id = 7 AND source_record_id = {REMOVED})""",
    "plans", "plan_sources", "plan_categories",
)
def event_removal(r):
    """The first record of source 7 goes, and its plan with its categories too if nothing else supports it."""
    links = r("plan_sources")
    first = links.where("source_id = 7").agg(F.min("source_record_id")).first()[0]
    after, _ = state.remove_event({"plans": r("plans"), "plan_sources": links, "plan_categories": r("plan_categories")}, 7, first, STAMP, purge_plan=True)
    rows = after["plans"].select(F.lit("plan").alias("relation"), "id", F.col("status").alias("value"))
    rows = rows.union(after["plan_categories"].select(F.lit("category"), "plan_id", F.col("category_id").cast("string")))
    return rows.union(after["plan_sources"].select(F.lit("link"), "id", F.col("plan_id").cast("string")))


@query(
    f"""SELECT 1 AS id, 7 AS source_id, '{STAMP}' AS started_at, CAST(NULL AS VARCHAR) AS finished_at, 'running' AS status, 0 AS fetched, 0 AS inserted, 0 AS updated, 0 AS skipped, 0 AS invalid, 0 AS errors, CAST(NULL AS VARCHAR) AS invalid_details
    UNION ALL SELECT 2, 7, '{STAMP}', '{STAMP}', 'completed', count(*), count(*) FILTER (issue IS NULL), 0, count(*) FILTER (issue IS NOT NULL), count(*) FILTER (issue IS NOT NULL), 0,
      (SELECT '[' || string_agg('{{"record_id":"r' || lpad(CAST(id AS VARCHAR), 9, '0') || '","reason":"' || issue || '"}}', ',' ORDER BY id) || ']' FROM (SELECT id, {ISSUE} AS issue FROM plans) x WHERE issue IS NOT NULL AND id IN (SELECT id FROM (SELECT id, {ISSUE} AS issue FROM plans) y WHERE issue IS NOT NULL ORDER BY id LIMIT 100))
    FROM (SELECT id, {ISSUE} AS issue FROM plans) t""",
    "plans",
)
def ledger_rows(r):
    issue = predicates.coherence_issue(clock.local_date(NOW).year)
    rows = r("plans").select(F.concat(F.lit("r"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("record_id"), issue.alias("reason"))
    counts = state.run_counts(rows.select(F.when(F.col("reason").isNull(), "inserted").otherwise("invalid").alias("outcome")))
    done = state.ledger_row(counts, rows.where("reason is not null"), 2, 7, STAMP, STAMP)
    return state.started_run(rows.sparkSession, 1, 7, STAMP).select(*done.columns).union(done)


@query(
    f"""SELECT i.id, url FROM images i JOIN plan_sources ps ON ps.id = i.plan_source_id JOIN sources s ON s.id = ps.source_id JOIN plans p ON p.id = ps.plan_id
    WHERE s.key = 'feed' AND s.enabled = 1 AND p.status = 'active'""",
    "images", "plan_sources", "sources", "plans",
)
def servable_images(r):
    return search.servable_images(r("images"), r("plan_sources"), r("sources"), r("plans"), "feed")


CACHED = "SELECT id AS image_id, sha256(CASE WHEN id % 3 = 0 THEN 'old' ELSE url END) AS source_hash, CASE WHEN id % 4 = 0 THEN '1998-06-15T03:00:00' ELSE '1998-06-15T09:00:00' END AS fetched_at FROM images"


@query(f"SELECT image_id FROM ({CACHED}) c JOIN images i ON i.id = c.image_id WHERE source_hash = sha256(url) AND fetched_at > '1998-06-15T06:00:00'", "images")
def cache_hits(r):
    ident = F.col("id")
    files = r("images").select(ident.alias("image_id"), F.sha2(F.when(ident % 3 == 0, "old").otherwise(F.col("url")), 256).alias("source_hash"), F.when(ident % 4 == 0, "1998-06-15T03:00:00").otherwise("1998-06-15T09:00:00").alias("fetched_at"))
    return state.cache_hits(files, r("images"), "1998-06-15T12:00:00", 6).select("image_id")


@query(
    """SELECT count(*) FILTER (a = 'orphan') AS orphaned, count(*) FILTER (a = 'expired') AS expired, count(*) FILTER (a = 'evicted') AS evicted, CAST(coalesce(sum(CASE WHEN a = 'kept' THEN size END), 0) AS BIGINT) AS bytes FROM (
      SELECT size, CASE WHEN pos % 10 = 3 THEN 'orphan' WHEN old THEN 'expired' WHEN sum(CASE WHEN pos % 10 <> 3 AND NOT old THEN size ELSE 0 END) OVER (ORDER BY fetched DESC, pos DESC ROWS UNBOUNDED PRECEDING) > 500000 THEN 'evicted' ELSE 'kept' END AS a
      FROM (SELECT pos, 100 + pos % 900 AS size, start_date || 'T' || start_time || ':00' AS fetched, start_date < '2024-01-10' AS old FROM feed) f) t""",
    "feed",
)
def cache_summary(r):
    files = r("feed").select(F.col("pos").alias("image_id"), (F.lit(100) + F.col("pos") % 900).alias("size"), F.concat("start_date", F.lit("T"), "start_time", F.lit(":00")).alias("fetched_at"))
    return state.cache_summary(state.cache_evictions(files, "2024-01-20T00:00:00", 240, 500_000, files.where("image_id % 10 <> 3").select("image_id")))


# ---- jobs ------------------------------------------------------------------------------------

GOOD_AGENDA = f"""SELECT *, {ISSUE} AS issue, {RETAINED} AND NOT ({OUTSIDE}) AS wanted FROM (
  SELECT *, 'event' AS kind, CAST(NULL AS VARCHAR) AS locality, {tk("title")} || '|' || {k("municipality")} || '|' || coalesce(start_date, CASE WHEN permanent = 1 THEN 'permanent' ELSE 'sense-data' END) AS fingerprint FROM ({AGENDA_PLANS}) a) b"""


#: Records that can't be taken over, and those of which the catalogue has the plan, or the link too.
POISONED, PLANNED, LINKED = "pos % 97 = 5", "pos % 3 = 0 AND pos % 97 <> 5", "pos % 6 = 0 AND pos % 97 <> 5"


@query(
    f""", good AS (SELECT *, CAST(substr(code, 2) AS BIGINT) AS pos FROM ({GOOD_AGENDA}) t), stored AS (SELECT fingerprint FROM good WHERE {PLANNED} AND issue IS NULL AND wanted),
    taken AS (SELECT * FROM good WHERE NOT ({POISONED}) AND issue IS NULL AND wanted),
    n AS (SELECT (SELECT count(*) FROM agenda) AS fetched, (SELECT count(DISTINCT fingerprint) FROM taken WHERE fingerprint NOT IN (SELECT fingerprint FROM stored)) AS inserted,
      (SELECT count(*) FROM taken WHERE {LINKED}) AS same, (SELECT count(*) FROM taken) AS taken, count(*) FILTER (NOT ({POISONED}) AND issue IS NOT NULL) AS invalid, count(*) FILTER ({POISONED}) AS errors FROM good)
    SELECT 8 AS source_id, CASE WHEN errors > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status, fetched, inserted, taken - same - inserted AS updated, fetched - errors - (taken - same) AS skipped, invalid, errors, least(invalid, 100) AS details FROM n""",
    "agenda",
)
def agenda_import(r):
    """The ledger's row of an import into a catalogue that has a third of the plans, and the links of half of these."""
    records = agenda(r).withColumn("horari", F.when(F.expr(POISONED), "x&#99999999;").otherwise(F.col("horari")))
    spark = records.sparkSession
    st = {n: spark.createDataFrame([], s) for n, s in TABLES.items()} | {"sources": r("sources"), "categories": seeded_categories(spark)}
    importer = jobs.AgendaImporter(records)
    rows = settled(importer.normalize(records.where(PLANNED)).withColumn("payload", importer.source_payload()).withColumn("source_record_id", importer.external_id()).drop("record"))
    whole = lambda df, name, **more: st[name].unionByName(df.withColumns(more).select(*(F.col(c).cast(st[name].schema[c].dataType) for c in st[name].columns if c in df.columns or c in more)), allowMissingColumns=True)
    ident = F.col("pos") + 1
    st["plans"] = whole(rows, "plans", id=ident)
    st["plan_sources"] = whole(rows.where(LINKED), "plan_sources", id=ident, plan_id=ident, source_id=F.lit(8), source_payload_json=F.col("payload"))
    folder = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    ledger = RunLedger(spark, folder, lambda: NOW)
    jobs.import_agenda(records, st, NOW, source=8, ledger=ledger)
    run = settled(ledger.read().select("source_id", "status", "fetched", "inserted", "updated", "skipped", "invalid", "errors", F.json_array_length("invalid_details").cast("long").alias("details")))
    remove_folder(spark, folder)
    return run


OFFERED = "SELECT i.*, ps.source_record_id AS event_id FROM images i JOIN plan_sources ps ON ps.id = i.plan_source_id WHERE ps.source_id = 8"
DUE = f"""SELECT l.id FROM (SELECT ps.id FROM plan_sources ps JOIN plans p ON p.id = ps.plan_id WHERE ps.source_id = 8 AND p.status = 'active') l
  LEFT JOIN (SELECT plan_source_id, count(*) AS n, min(last_seen_at) AS oldest FROM images GROUP BY 1) i ON i.plan_source_id = l.id WHERE coalesce(n, 0) < 2 OR oldest IS NULL OR oldest <= '1998-06-14T12:00:00.000Z'"""


@query(
    f""", owned AS (SELECT due.id AS owner, o.url, ratio, width + 1 AS width, height, is_fallback, attribution FROM ({OFFERED}) o JOIN (SELECT ps.id, ps.source_record_id FROM plan_sources ps WHERE ps.id IN ({DUE})) due ON due.source_record_id = o.event_id),
    best AS (SELECT owner, role, width, url, ratio, height, is_fallback, attribution FROM (SELECT o.*, r.role, row_number() OVER (PARTITION BY owner, r.role ORDER BY CASE WHEN ratio = '16_9' THEN 0 ELSE 1 END, is_fallback, abs(width - w) + abs(height - h), width, url) AS n
      FROM owned o CROSS JOIN (VALUES ('card', 640, 360), ('detail', 1136, 639)) r(role, w, h) WHERE {GOOD_IMAGE}) t WHERE n = 1),
    old AS (SELECT * FROM images WHERE plan_source_id IN (SELECT owner FROM best))
    SELECT action, count(*) AS n FROM (SELECT CASE WHEN o.role IS NULL THEN 'created' WHEN b.role IS NULL THEN 'removed' WHEN o.url = b.url AND o.ratio = b.ratio AND o.width = b.width AND o.height = b.height AND o.is_fallback = b.is_fallback AND o.attribution = b.attribution THEN 'unchanged' ELSE 'updated' END AS action
      FROM old o FULL JOIN best b ON b.owner = o.plan_source_id AND b.role = o.role) t GROUP BY action""",
    "plans", "plan_sources", "images",
)
def image_sync(r):
    st = {n: r(n) for n in ("plans", "plan_sources", "images", "sources")}
    mine = st["plan_sources"].where("source_id = 8").select(F.col("id").alias("plan_source_id"), F.col("source_record_id").alias("event_id"))
    offered = st["images"].join(mine, "plan_source_id").select("event_id", "url", "ratio", (F.col("width") + 1).alias("width"), "height", "is_fallback", "attribution")
    return jobs.sync_images(st, offered, NOW, source=8)[1]


_WEEKEND, _UPCOMING = ORDERS["editorial_weekend"], ORDERS["editorial_upcoming"]
_SATURDAY = (_WEEKEND[1].replace("1998-07-01", "1998-07-03"), _WEEKEND[2].replace("1998-07-01", "1998-07-03"))


@query(
    f""", weekend AS (SELECT id, row_number() OVER (ORDER BY {_SATURDAY[1]}) AS n FROM visible WHERE {_SATURDAY[0]} QUALIFY n <= 6),
    upcoming AS (SELECT id, start_date, row_number() OVER (ORDER BY {_UPCOMING[2]}) AS n FROM visible WHERE {_UPCOMING[1]} QUALIFY n <= 18)
    SELECT 'weekend' AS part, CAST(id AS VARCHAR) AS item FROM weekend
    UNION ALL SELECT 'upcoming', CAST(id AS VARCHAR) FROM (SELECT * FROM upcoming WHERE id NOT IN (SELECT id FROM weekend) ORDER BY start_date, id LIMIT 6) u
    UNION ALL SELECT 'permanent', CAST(id AS VARCHAR) FROM (SELECT id FROM visible WHERE permanent = 1 ORDER BY quality_score DESC, start_date IS NULL, start_date NULLS FIRST, id LIMIT 3) p
    UNION ALL SELECT 'categories', slug FROM (SELECT slug FROM categories ORDER BY slug LIMIT 8) c""",
    "plans", "categories",
)
def home_page(r):
    page = jobs.home({"plans": r("plans"), "categories": r("categories")}, date(1998, 7, 1), NOW)
    parts = [page[n].select(F.lit(n).alias("part"), F.col("id").cast("string").alias("item")) for n in ("weekend", "upcoming", "permanent")]
    return parts[0].union(parts[1]).union(parts[2]).union(page["categories"].select(F.lit("categories"), "slug"))


# ---- what a reader sees ----------------------------------------------------------------------

MONTHS = "['gener', 'febrer', 'març', 'abril', 'maig', 'juny', 'juliol', 'agost', 'setembre', 'octubre', 'novembre', 'desembre']"
DAY = "CASE WHEN regexp_full_match(start_date, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN try_cast(start_date AS DATE) END"


@query(f"SELECT id, day(d) || ' de ' || ({MONTHS})[month(d)] || ' de ' || year(d) AS shown FROM (SELECT id, {DAY} AS d FROM plans) t", "plans")
def long_dates(r):
    return r("plans").select("id", present.long_date(F.col("start_date"), "ca").alias("shown"))


@query(
    """SELECT v.id, coalesce((SELECT min(slug) FROM plan_categories pc JOIN categories c ON c.id = pc.category_id WHERE pc.plan_id = v.id), kind) AS primary_category,
    CASE WHEN id % 2 = 0 THEN '/media/' || id WHEN image_reuse_allowed = 1 THEN image_url END AS image, (SELECT substr(max(coalesce(source_updated_at, imported_at)), 1, 10) FROM plan_sources ps WHERE ps.plan_id = v.id) AS attributed FROM visible v""",
    "plans", "plan_categories", "categories", "plan_sources",
)
def card_extras(r):
    rows = search.category_lists(shown(r).select("id", "kind", "image_url", (F.col("image_reuse_allowed") == 1).alias("image_reuse_allowed")), r("plan_categories"), r("categories"))
    dated = r("plan_sources").groupBy(F.col("plan_id").alias("id")).agg(F.max("source_updated_at").alias("source_updated_at"), F.max("imported_at").alias("imported_at"))
    rows = rows.join(dated, "id", "left").withColumn("image", F.struct(F.when(F.col("id") % 2 == 0, F.concat(F.lit("/media/"), F.col("id").cast("string"))).alias("url")))
    return rows.select("id", present.primary_category().alias("primary_category"), present.shown_image().alias("image"), present.attribution_date().alias("attributed"))


@query(
    """SELECT id, url, regexp_full_match(url, 'https://i\\.example/.*') AS allowed FROM (SELECT id, CASE id % 5 WHEN 0 THEN 'https://user@i.example/x' WHEN 1 THEN 'https://i.example.evil/x' WHEN 2 THEN 'ftp://i.example/x' ELSE url END AS url FROM images) t""",
    "images",
)
def media_hosts(r):
    ident = F.col("id")
    odd = F.when(ident % 5 == 0, "https://user@i.example/x").when(ident % 5 == 1, "https://i.example.evil/x").when(ident % 5 == 2, "ftp://i.example/x").otherwise(F.col("url"))
    return r("images").withColumn("url", odd).select("id", "url", predicates.media_url("i.example").alias("allowed"))


@query("SELECT id FROM plans WHERE contains(lower(strip_accents(concat_ws(' ', municipality, comarca, province))), 'africa')", "plans")
def combobox_matches(r):
    return r("plans").where(predicates.combobox("Nació Tres", {"nacio tres": "africa"})).select("id")


@query(f"SELECT id, start_date FROM visible WHERE {FOUND['search_range'][1]} AND is_free = 0 AND {nc('province')} = 'asia'", "plans")
def search_parsed(r):
    sent = search.shared_filters({"dateFrom": "1998-07-01", "dateTo": "1998-07-31", "free": "false", "province": "Asia", "family": "false", "sort": "title"}) | {"free": "false"}
    return search.matching(r("plans"), search.parse_filters(sent), NOW).select("id", "start_date")


@query("SELECT id, is_free, family_friendly, indoor FROM visible WHERE is_free = 1 AND family_friendly = 1 AND indoor = 1", "plans")
def search_flags_true(r):
    return search.matching(r("plans"), Filters(free=1, family=1, indoor=1), NOW).select("id", "is_free", "family_friendly", "indoor")


@query("SELECT id, is_free, outdoor, permanent FROM visible WHERE is_free = 0 AND outdoor = 0 AND permanent = 0", "plans")
def search_flags_false(r):
    return search.matching(r("plans"), Filters(free=0, outdoor=0, permanent=0), NOW).select("id", "is_free", "outdoor", "permanent")


SHOWN_ID = "(SELECT max(id) FROM visible WHERE kind = 'event')"


@query(f"SELECT id, {TITLE['es']} AS title, start_date, quality_score, is_free = 1 AS free, permanent = 1 AS permanent, FALSE AS leaks FROM visible WHERE id = {SHOWN_ID}", "plans")
def plan_detail_shown(r):
    """The last event that can be seen, in Spanish."""
    ident = shown(r).where("kind = 'event'").agg(F.max("id")).first()[0]
    row = search.detail(r("plans"), ident, NOW, "es")
    return row.select("id", "title", "start_date", "quality_score", "free", "permanent", F.lit("fingerprint" in row.columns).alias("leaks"))


@query("SELECT id FROM visible WHERE id = (SELECT max(id) FROM plans WHERE status = 'inactive') UNION ALL SELECT count(*) FROM visible WHERE id = (SELECT max(id) FROM plans WHERE status = 'inactive')", "plans")
def plan_detail_hidden(r):
    """A plan that may not be seen is not found: no row, and a count of 0."""
    ident = r("plans").where("status = 'inactive'").agg(F.max("id")).first()[0]
    row = search.detail(r("plans"), ident, NOW).select("id")
    return row.union(row.agg(F.count("*").alias("id")))


@query(
    """SELECT id + 1 AS position, '<url><loc>https://site.example?a=1&amp;b=&apos;&lt;x&gt;&quot;/plans/' || id || '</loc></url>' AS line FROM visible WHERE kind = 'event'
    UNION ALL SELECT 0, '<url><loc>https://site.example?a=1&amp;b=&apos;&lt;x&gt;&quot;/</loc></url>'""",
    "plans",
)
def sitemap_escaped(r):
    return search.sitemap_entries(shown(r), "https://site.example?a=1&b='<x>\"", ("/",))


@query(
    """SELECT kind, kind <> 'event' AS filtered, 'Plans' AS title, CASE WHEN kind <> 'event' THEN 'noindex,follow' ELSE 'index,follow' END AS robots, 'https://site.example/plans' AS canonical, count(*) AS plans FROM visible GROUP BY kind""",
    "plans",
)
def list_pages(r):
    """The page of all events, and a filtered one for each other kind, with how many plans they list."""
    of = lambda filtered: F.struct(*(F.lit(v).alias(n) for n, v in present.list_meta(filtered, "https://site.example", "Plans").items()))
    rows = shown(r).groupBy("kind").agg(F.count("*").alias("plans")).withColumn("filtered", F.col("kind") != "event")
    return rows.withColumn("m", F.when(F.col("filtered"), of(True)).otherwise(of(False))).select("kind", "filtered", "m.*", "plans")


@plain(
    """SELECT event_id, strftime(ts + INTERVAL 1 HOUR - INTERVAL 30 DAY, '%Y-%m-%d') AS retention, strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d') AS first, strftime(ts + INTERVAL 1 HOUR + INTERVAL 90 DAY, '%Y-%m-%d') AS last,
    strftime(ts - INTERVAL 7 DAY, '%Y-%m-%dT%H:%M:%S') || substr(strftime(ts, '%f'), 1, 0) AS inactive, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S.000Z') AS dataset FROM events"""
)
def calendar_bounds(spark, sf_dir):
    """The calendar of every event's instant, which lies in winter."""
    at = F.col("ts").cast("timestamp")
    first, last = clock.horizon_days(at)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select("event_id", clock.retention_day(at, 30).alias("retention"), first.alias("first"), last.alias("last"), F.substring(clock.inactive_instant(at), 1, 19).alias("inactive"), readers.dataset_timestamp(F.unix_seconds(at)).alias("dataset"))


@plain(
    """SELECT o_orderkey, strftime(d, '%Y-%m-%d') AS today, strftime(d + 1, '%Y-%m-%d') AS tomorrow, strftime(d + 6, '%Y-%m-%d') AS next7_last, strftime(d + CAST(greatest(0, 5 - isodow(d)) AS INTEGER), '%Y-%m-%d') AS weekend_first, strftime(d + CAST(7 - isodow(d) AS INTEGER), '%Y-%m-%d') AS weekend_last
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) t"""
)
def quick_ranges(spark, sf_dir):
    """The quick ranges of every order's day."""
    day = F.to_date("o_orderdate")
    of = lambda kind, i, name: clock.quick_days(kind, day)[i].alias(name)
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rows.select("o_orderkey", of("today", 0, "today"), of("tomorrow", 0, "tomorrow"), of("next7", 1, "next7_last"), of("weekend", 0, "weekend_first"), of("weekend", 1, "weekend_last"))


@query(
    f"""SELECT id, {k("municipality")} AS town, ({OUTSIDE}) AS outside, ({ISSUE}) IS NOT NULL AS faulty FROM plans""",
    "plans",
)
def sql_functions(r):
    """The registered SQL functions."""
    from .functions.sql import register_functions

    plans = r("plans")
    register_functions(plans.sparkSession)
    return plans.select(
        "id", F.expr("normalize_location(municipality)").alias("town"), F.expr("is_outside_territory(province, comarca, municipality, locality)").alias("outside"),
        F.expr("is_temporally_invalid(kind, permanent, start_date, end_date, 1998)").alias("faulty"),
    )


@query("SELECT p.id, p.status, (SELECT count(*) FROM plan_sources ps WHERE ps.plan_id = p.id) AS links, (SELECT max(last_seen_at) FROM plan_sources ps WHERE ps.plan_id = p.id) AS seen FROM plans p", "plans", "plan_sources")
def stored_state(r):
    """The state after it was written as a snapshot and read again."""
    plans, links = r("plans"), r("plan_sources")
    spark = plans.sparkSession
    root = f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}"
    empty = {n: spark.createDataFrame([], s) for n, s in TABLES.items()}
    write_snapshot(spark, empty, root)
    write_snapshot(spark, empty | {"plans": plans, "plan_sources": links}, root)
    st = read_snapshot(spark, root)
    counted = st["plan_sources"].groupBy(F.col("plan_id").alias("id")).agg(F.count("*").alias("links"), F.max("last_seen_at").alias("seen"))
    rows = settled(st["plans"].select("id", "status").join(counted, "id", "left").select("id", "status", F.coalesce("links", F.lit(0)).alias("links"), "seen"))
    remove_folder(spark, root)
    return rows


assert TODAY and LAST and feeds and QUERIES  # the names above are shared with ``queries``
