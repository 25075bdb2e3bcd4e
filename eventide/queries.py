"""The registered queries of the catalogue operators, each with an independent SQL form.

Queries run on the relations of ``testdata``, over whole tables, with the frozen clock.  Order is
shown as a rank column, nested lists as text, so that both sides compare row by row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import clock
from .functions import text as X
from .operators import feed as feeds
from .operators import normalize, predicates, present, search, state
from .operators.ordering import numbered
from .operators.search import Filters
from .testdata import NOW, relation, relation_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FROM, TO, DAY = "1998-07-01", "1998-07-31", "1998-07-10"
TODAY, LAST = clock.horizon(NOW)


# ---- pieces of SQL ---------------------------------------------------------------------------


def k(c: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents(coalesce({c}, ''))), '[^a-z0-9]+', '-', 'g'), '-')"


def tk(c: str) -> str:
    articles = ", ".join(f"'{a}'" for a in X.ARTICLES)
    return f"array_to_string([w for w in string_split({k(c)}, '-') if w NOT IN ({articles})], '-')"


def nc(c: str) -> str:
    return f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


END = "coalesce(end_date, start_date)"
RETAINED = f"(permanent = 1 OR {END} IS NULL OR {END} >= '1998-06-15')"
# Place words, as in ``operators.predicates``.
_NOUN = "(catalunya|cataluna|espanya|espana|estat espanyol|estado espanol)"
OUTSIDE = " OR ".join(
    f"regexp_full_match(replace({k(c)}, '-', ' '), 'fora (de |d |del |de l )?{_NOUN}|fuera (de |del )?{_NOUN}|outside (of )?(catalonia|catalunya|spain)')"
    for c in ("province", "comarca", "municipality", "locality")
)


def strict(c: str) -> str:
    return f"CASE WHEN regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_cast({c} AS DATE) END"


ISSUE = f"""CASE WHEN kind = 'event' AND permanent <> 1 THEN CASE
  WHEN (start_date IS NOT NULL AND {strict("start_date")} IS NULL) OR (end_date IS NOT NULL AND {strict("end_date")} IS NULL) THEN 'INVALID_DATE_FORMAT'
  WHEN {strict("end_date")} < {strict("start_date")} THEN 'END_BEFORE_START'
  WHEN year({strict("start_date")}) > 2008 OR year({strict("end_date")}) > 2008 THEN 'EXTREME_FUTURE_DATE'
  WHEN {strict("end_date")} > {strict("start_date")} + INTERVAL 10 YEAR THEN 'EVENT_DURATION_EXCEEDS_10_YEARS' END END"""
VISIBLE = f"status = 'active' AND quality_score >= 35 AND {RETAINED} AND NOT ({OUTSIDE}) AND ({ISSUE}) IS NULL"
TITLE = {
    "ca": "coalesce(nullif(title_ca, ''), nullif(original_title, ''), nullif(title_es, ''))",
    "es": "coalesce(nullif(title_es, ''), nullif(original_title, ''), nullif(title_ca, ''))",
}


def sql(body: str, *relations: str) -> str:
    """``body`` after the relations that it names; ``visible`` stands on plans."""
    parts = [f"{n} AS ({relation_sql(n, 'duckdb')})" for n in relations]
    if "plans" in relations:
        parts.append(f"visible AS (SELECT * FROM plans WHERE {VISIBLE})")
    return "WITH " + ",\n".join(parts) + "\n" + body


def query(oracle: str | None = None, *relations: str):
    """Registers a function of (relations by name) as a query under its own name."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: relation(spark, sf_dir, name))

        QUERIES[f.__name__] = run
        if oracle is not None:
            ORACLES[f.__name__] = sql(oracle, *relations) if relations else oracle
        return f

    return register


def plain(oracle: str):
    """Registers a function of (spark, sf_dir)."""

    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return register


def ranked(df: DataFrame, *order) -> DataFrame:
    """``df`` (with an ``id``) with its rank, so that an order can be compared; no task ranks all rows."""
    keyed = df.withColumn("_key", F.struct(*order)).withColumnRenamed("id", "_own")
    return numbered(keyed, 0, "_key").withColumnRenamed("id", "rank").withColumnRenamed("_own", "id").drop("_key")


def shown(r) -> DataFrame:
    return r("plans").where(predicates.visible(NOW))


# ---- search ----------------------------------------------------------------------------------

DATED = "start_date IS NOT NULL AND end_date IS NOT NULL"
FOUND = {
    "search_text": (Filters(q="THÉ of!"), f"(contains({k('original_title')}, 'the-of') OR contains({k('title_ca')}, 'the-of') OR contains({k('title_es')}, 'the-of') OR contains({k('venue_name')}, 'the-of'))"),
    "search_location": (Filters(municipality="Búilding", comarca="Nation 3"), f"{k('municipality')} = 'building' AND {k('comarca')} = 'nation-3'"),
    "search_nocase": (Filters(kind="route"), f"{nc('kind')} = 'route'"),
    "search_flags": (Filters(free=1, family=1), "is_free = 1 AND family_friendly = 1"),
    "search_day": (Filters(date=DAY), f"(permanent = 1 OR ({DATED} AND start_date <= '{DAY}' AND end_date >= '{DAY}'))"),
    "search_range": (Filters(date_from=FROM, date_to=TO), f"(permanent = 1 OR ({DATED} AND start_date <= '{TO}' AND end_date >= '{FROM}'))"),
    "search_from": (Filters(date_from=FROM), f"(permanent = 1 OR (end_date IS NOT NULL AND end_date >= '{FROM}'))"),
    "search_to": (Filters(date_to=TO), f"(permanent = 1 OR (start_date IS NOT NULL AND start_date <= '{TO}'))"),
    "search_upcoming": (Filters(editorial="home-upcoming", date_from=FROM), f"start_date >= '{FROM}'"),
}


def _register_found(name: str, filters: Filters, where: str) -> None:
    def run(spark, sf_dir):
        return search.matching(relation(spark, sf_dir, "plans"), filters, NOW).select("id", "start_date", "quality_score")

    QUERIES[name], ORACLES[name] = run, sql(f"SELECT id, start_date, quality_score FROM visible WHERE {where}", "plans")


for _name, (_filters, _where) in FOUND.items():
    _register_found(_name, _filters, _where)


@query("SELECT id, start_date FROM visible WHERE id IN (SELECT plan_id FROM plan_categories JOIN categories c ON c.id = category_id WHERE slug IN ('promo', 'small'))", "plans", "plan_categories", "categories")
def search_category_any(r):
    return search.matching(r("plans"), Filters(categories=("promo", "small")), NOW, r("plan_categories"), r("categories")).select("id", "start_date")


ORDERS = {
    "search_default_page": (Filters(date_from=FROM, date_to=TO, page=2, limit=20), FOUND["search_range"][1], "permanent, start_date IS NULL, start_date NULLS FIRST, id", "ca"),
    "order_day": (Filters(date=DAY, limit=100), FOUND["search_day"][1], f"CASE WHEN permanent = 0 AND start_date = '{DAY}' THEN 0 WHEN permanent = 0 THEN 1 ELSE 2 END, start_date DESC NULLS LAST, id", "ca"),
    "order_quality": (Filters(sort="quality", limit=50), "true", "quality_score DESC, start_date IS NULL, start_date NULLS FIRST, id", "ca"),
    "order_title": (Filters(sort="title", lang="es", limit=50), "true", f"{nc(TITLE['es'])} NULLS FIRST, id", "es"),
    "editorial_weekend": (Filters(editorial="home-weekend", date_from=FROM, date_to="1998-07-05", limit=50), f"(permanent = 1 OR ({DATED} AND start_date <= '1998-07-05' AND end_date >= '{FROM}'))", f"CASE WHEN start_date BETWEEN '{FROM}' AND '1998-07-05' THEN 0 ELSE 1 END, CASE WHEN start_date BETWEEN '{FROM}' AND '1998-07-05' THEN start_date END NULLS FIRST, CASE WHEN start_date < '{FROM}' THEN start_date END DESC NULLS LAST, id", "ca"),
    "editorial_upcoming": (Filters(editorial="home-upcoming", date_from=FROM, limit=18), FOUND["search_upcoming"][1], "start_date NULLS FIRST, id", "ca"),
}


def _register_order(name: str, filters: Filters, where: str, order: str, lang: str) -> None:
    first, last = (filters.page - 1) * filters.limit, filters.page * filters.limit

    def run(spark, sf_dir):
        found = search.matching(relation(spark, sf_dir, "plans"), filters, NOW)
        rows = search.page(found, filters)
        flags = {n: F.col(n).cast("int") for n in ("permanent", "free", "family", "indoor", "outdoor", "featured", "image_reuse_allowed")}
        return rows.withColumns(flags).select("rank", "id", "title", "subtitle", "start_date", "image_url", *flags)

    body = f"""SELECT CAST(n AS INT) AS rank, id, {TITLE[lang]} AS title,
      {"coalesce(nullif(subtitle_es, ''), nullif(subtitle_ca, ''))" if lang == "es" else "coalesce(nullif(subtitle_ca, ''), nullif(subtitle_es, ''))"} AS subtitle, start_date,
      CASE WHEN image_reuse_allowed = 1 THEN image_url END AS image_url, permanent, is_free AS free, family_friendly AS family, indoor, outdoor, featured, image_reuse_allowed
      FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS n FROM visible WHERE {where}) t WHERE n > {first} AND n <= {last}"""
    QUERIES[name], ORACLES[name] = run, sql(body, "plans")


for _name, _spec in ORDERS.items():
    _register_order(_name, *_spec)


@query(f"SELECT 2 AS page, 20 AS \"limit\", count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM visible WHERE {FOUND['search_range'][1]}", "plans")
def pagination_envelope(r):
    filters = ORDERS["search_default_page"][0]
    return search.envelope(search.matching(r("plans"), filters, NOW), filters)


@query(
    f"""SELECT id, {TITLE["ca"]} AS title, coalesce(nullif(description_ca, ''), nullif(original_description, ''), nullif(description_es, '')) AS description,
    {TITLE["es"]} AS title_2, coalesce(nullif(description_es, ''), nullif(original_description, ''), nullif(description_ca, '')) AS description_2 FROM plans""",
    "plans",
)
def localized_text(r):
    ca, es = search.localized("ca"), search.localized("es")
    return r("plans").select("id", ca["title"].alias("title"), ca["description"].alias("description"), es["title"].alias("title_2"), es["description"].alias("description_2"))


@query(
    """SELECT v.id, coalesce((SELECT string_agg(slug || ':' || coalesce(nullif(name_ca, ''), nullif(name_es, '')), ',' ORDER BY slug)
    FROM plan_categories pc JOIN categories c ON c.id = pc.category_id WHERE pc.plan_id = v.id), '') AS categories FROM visible v""",
    "plans", "plan_categories", "categories",
)
def plan_categories_list(r):
    rows = search.category_lists(shown(r).select("id"), r("plan_categories"), r("categories"))
    return rows.select("id", F.array_join(F.transform("categories", lambda c: F.concat(c["slug"], F.lit(":"), c["name"])), ",").alias("categories"))


@query(
    """SELECT v.id, (SELECT string_agg(s.name || '@' || ps.source_updated_at, ',' ORDER BY s.name, ps.source_updated_at DESC, ps.imported_at DESC, ps.id)
    FROM plan_sources ps JOIN sources s ON s.id = ps.source_id WHERE ps.plan_id = v.id) AS sources FROM visible v""",
    "plans", "plan_sources", "sources",
)
def plan_sources_list(r):
    rows = search.source_lists(shown(r).select("id"), r("plan_sources"), r("sources"))
    return rows.select("id", F.array_join(F.transform("sources", lambda s: F.concat(s["name"], F.lit("@"), s["source_updated_at"])), ",").alias("sources"))


@query(
    """SELECT v.id, i.image_id, i.width, i.height, i.attribution FROM visible v LEFT JOIN (
      SELECT ps.plan_id, im.id AS image_id, width, height, nullif(attribution, '') AS attribution,
        row_number() OVER (PARTITION BY ps.plan_id ORDER BY is_fallback, im.last_seen_at DESC NULLS LAST, im.id) AS n
      FROM images im JOIN plan_sources ps ON ps.id = im.plan_source_id JOIN sources s ON s.id = ps.source_id
      WHERE im.role = 'card' AND s.key = 'feed' AND s.enabled = 1) i ON i.plan_id = v.id AND i.n = 1""",
    "plans", "images", "plan_sources", "sources",
)
def plan_image(r):
    rows = search.with_images(shown(r).select("id"), search.best_images(r("images"), r("plan_sources"), r("sources"), "card", "feed"))
    return rows.select("id", F.substring_index("image.url", "/", -1).cast("long").alias("image_id"), "image.width", "image.height", "image.attribution")


@query(f"SELECT id, {TITLE['es']} AS title, start_date, quality_score FROM visible WHERE id = (SELECT min(id) FROM visible)", "plans")
def plan_detail(r):
    """The first plan that can be seen."""
    first = shown(r).agg(F.min("id")).first()[0]
    return search.detail(r("plans"), first, NOW, "es").select("id", "title", "start_date", "quality_score")


@query(f"SELECT province, row_number() OVER (ORDER BY {nc('province')}, province) AS rank FROM (SELECT DISTINCT province FROM visible WHERE trim(province) <> '') t", "plans")
def provinces(r):
    return search.provinces(shown(r)).select("province", F.row_number().over(Window.orderBy(X.nocase(F.col("province")), "province")).cast("long").alias("rank"))


@query(f"SELECT arg_min(comarca, province) AS comarca, min(province) AS province FROM visible WHERE trim(comarca) <> '' GROUP BY {nc('comarca')}", "plans")
def comarques(r):
    return search.comarques(shown(r))


@query(f"SELECT min(municipality) AS municipality, min(comarca) AS comarca, min(province) AS province FROM visible WHERE trim(municipality) <> '' AND {nc('province')} = 'asia' GROUP BY {nc('municipality')}", "plans")
def municipalities(r):
    return search.municipalities(shown(r), province="ASIA")


@query("SELECT id FROM visible WHERE kind = 'event'", "plans")
def sitemap_ids(r):
    return search.sitemap_ids(shown(r))


@query(
    """SELECT id + 3 AS position, '<url><loc>https://site.example/plans/' || id || '</loc></url>' AS line FROM visible WHERE kind = 'event'
    UNION ALL SELECT * FROM (VALUES (0, '<url><loc>https://site.example/</loc></url>'), (1, '<url><loc>https://site.example/plans</loc></url>'), (2, '<url><loc>https://site.example/about</loc></url>'))""",
    "plans",
)
def sitemap_xml(r):
    return search.sitemap_entries(shown(r), "https://site.example")


_WEEKEND, _UPCOMING = ORDERS["editorial_weekend"], ORDERS["editorial_upcoming"]


@query(
    f"""SELECT id, start_date FROM (SELECT * FROM visible WHERE {_UPCOMING[1]} ORDER BY {_UPCOMING[2]} LIMIT 18) u
    WHERE id NOT IN (SELECT id FROM visible WHERE {_WEEKEND[1]} ORDER BY {_WEEKEND[2]} LIMIT 6) ORDER BY start_date, id LIMIT 6""",
    "plans",
)
def home_upcoming_minus_weekend(r):
    plans = r("plans")
    upcoming = search.matching(plans, _UPCOMING[0], NOW).orderBy(*search.order(_UPCOMING[0])).limit(18)
    weekend = search.matching(plans, _WEEKEND[0], NOW).orderBy(*search.order(_WEEKEND[0])).limit(6)
    return search.home_upcoming(upcoming, weekend).select("id", "start_date")


# ---- predicates and scalars ------------------------------------------------------------------


@query(
    f"""SELECT id, {ISSUE} AS issue, CAST({RETAINED} AS INT) AS retained, CAST(({OUTSIDE}) AS INT) AS outside,
    CAST(coalesce(permanent <> 1 AND {END} IS NOT NULL AND {END} < '1998-06-15', false) AS INT) AS expired FROM plans""",
    "plans",
)
def plan_predicates(r):
    cutoff = clock.retention_cutoff(NOW)
    as_int = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return r("plans").select(
        "id", predicates.coherence_issue(clock.local_date(NOW).year).alias("issue"), as_int(predicates.retained(cutoff)).alias("retained"),
        as_int(predicates.outside_territory()).alias("outside"), as_int(predicates.expired(cutoff)).alias("expired"),
    )


@plain(f"SELECT doc_id, {k('text')} AS text_key, {tk('text')} AS title_key FROM documents")
def norm_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", X.key(F.col("text")).alias("text_key"), X.title_key(F.col("text")).alias("title_key"))


_STRIPPED = "html"
for _pattern, _new in (("(?i)<br\\s*/?>|</p>", " "), ("<[^>]*>", " "), ("(?i)&nbsp;|&#160;", " "), ("(?i)&amp;", "&"), ("(?i)&quot;", '"'), ("(?i)&#39;|&apos;", "''"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("[\\s\\x{0B}\\x{85}\\x{A0}\\x{2000}-\\x{200A}]+", " ")):
    _STRIPPED = f"regexp_replace({_STRIPPED}, '{_pattern}', '{_new}', 'g')"


@plain(f"SELECT page_id, nullif(trim({_STRIPPED}), '') AS body FROM pages")
def strip_html(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", X.strip_html(F.col("html")).alias("body"))


@plain(
    """SELECT doc_id, CASE WHEN length(line) <= 160 THEN line ELSE regexp_replace(substr(line, 1, 160), ' [^ ]*$', '') || '…' END AS short
    FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS line FROM documents) t"""
)
def compact_text(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", X.compact(F.col("text")).alias("short"))


@query(
    """SELECT id, round(longitude - 0.009, 6) AS west, round(latitude - 0.006, 6) AS south, round(longitude + 0.009, 6) AS east, round(latitude + 0.006, 6) AS north, 4 AS corners, latitude AS marker_latitude, longitude AS marker_longitude
    FROM plans WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180
    UNION ALL SELECT id, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM plans WHERE NOT coalesce(latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180, FALSE)""",
    "plans",
)
def map_bbox(r):
    """The four sides, and what the map's query says: its corners and the marker."""
    rows = r("plans").withColumn("m", present.map_box()).withColumn("q", F.url_decode("m.query"))
    marker = F.split(F.substring_index("q", "&marker=", -1), ",")
    corners = F.transform(F.split(F.substring_index(F.substring_index("q", "&marker=", 1), "bbox=", -1), ","), lambda x: F.round(x.cast("double"), 6))
    sides = [F.round(f"m.{n}", 6) for n in ("west", "south", "east", "north")]
    same = F.when(corners == F.array(*sides), F.size(corners))
    return rows.select("id", *(s.alias(n) for s, n in zip(sides, ("west", "south", "east", "north"))), same.alias("corners"), marker[0].cast("double").alias("marker_latitude"), marker[1].cast("double").alias("marker_longitude"))


@query(
    """SELECT id, CASE WHEN permanent = 1 THEN 'permanent' WHEN end_date IS NOT NULL AND end_date <> '' AND end_date <> start_date THEN start_date || ' – ' || end_date ELSE start_date END AS dates,
    CASE WHEN is_free = 1 THEN 'free' ELSE coalesce(nullif(price_text, ''), 'unknown') END AS price,
    CASE WHEN nullif(venue_name, '') IS NOT NULL THEN concat_ws(' · ', venue_name, nullif(municipality, '')) ELSE concat_ws(' · ', nullif(municipality, ''), comarca) END AS place,
    concat_ws(' · ', nullif(municipality, ''), comarca, province) AS location FROM plans""",
    "plans",
)
def card_labels(r):
    return r("plans").select("id", present.date_label().alias("dates"), present.price_label().alias("price"), present.place_label().alias("place"), present.location_label().alias("location"))


KNOWN = f"""{TITLE["ca"]} IS NOT NULL AND regexp_full_match(start_date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND nullif(venue_name, '') IS NOT NULL AND coalesce(nullif(municipality, ''), nullif(comarca, ''), nullif(province, '')) IS NOT NULL"""
LD = ("name", "start_date", "end_date", "description", "url", "venue", "street", "town", "region", "postal")


@query(
    f"""SELECT id, CASE WHEN known THEN 'Event' END AS kind, {", ".join(f"CASE WHEN known THEN {c} END AS {c}" for c in LD)} FROM (SELECT id, {KNOWN} AS known, {TITLE["ca"]} AS name, start_date, nullif(end_date, '') AS end_date,
    coalesce(nullif(description_ca, ''), nullif(original_description, ''), nullif(description_es, '')) AS description, website_url AS url, venue_name AS venue, nullif(address, '') AS street, nullif(municipality, '') AS town, nullif(province, '') AS region, nullif(postal_code, '') AS postal FROM visible) t""",
    "plans",
)
def json_ld(r):
    """All fields of a plan's description for machines."""
    texts = search.localized("ca")
    rows = shown(r).select("id", present.json_ld(texts["title"], F.col("website_url"), texts["description"]).alias("j"))
    paths = ("name", "startDate", "endDate", "description", "url", "location.name", "location.address.streetAddress", "location.address.addressLocality", "location.address.addressRegion", "location.address.postalCode")
    event = F.parse_json("j")
    return rows.select("id", F.try_variant_get(event, "$['@type']", "string").alias("kind"), *(F.try_variant_get(event, f"$.{p}", "string").alias(n) for n, p in zip(LD, paths)))


@query(
    f"""SELECT id, concat_ws(' | ', concat_ws(' · ', {TITLE["ca"]}, nullif(municipality, '')), 'Site') AS title,
    CASE WHEN kind = 'event' THEN 'index,follow' ELSE 'noindex,follow' END AS robots, 'https://site.example/plans/' || id AS canonical FROM visible""",
    "plans",
)
def page_meta(r):
    return shown(r).withColumn("m", present.page_meta(search.localized("ca")["title"], "https://site.example", "Site")).select("id", "m.*")


# ---- normalisation ---------------------------------------------------------------------------


@query(
    """SELECT id, least(100, 5 + CASE WHEN original_title <> '' THEN 15 ELSE 0 END + CASE WHEN original_description <> '' THEN 15 ELSE 0 END
    + CASE WHEN start_date <> '' OR permanent = 1 THEN 10 ELSE 0 END + CASE WHEN municipality <> '' THEN 10 ELSE 0 END + CASE WHEN comarca <> '' THEN 5 ELSE 0 END
    + CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN address <> '' THEN 5 ELSE 0 END + CASE WHEN website_url <> '' THEN 10 ELSE 0 END
    + CASE WHEN price_text <> '' OR is_free IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN schedule_text <> '' THEN 5 ELSE 0 END + CASE WHEN coalesce(n, 0) > 0 THEN 5 ELSE 0 END) AS agenda,
    least(100, 30 + CASE WHEN original_description <> '' THEN 15 ELSE 0 END + CASE WHEN municipality <> '' THEN 10 ELSE 0 END + CASE WHEN latitude IS NOT NULL THEN 10 ELSE 0 END
    + CASE WHEN address <> '' THEN 5 ELSE 0 END + CASE WHEN ticket_url <> '' THEN 10 ELSE 0 END + CASE WHEN coalesce(n, 0) > 0 THEN 5 ELSE 0 END) AS feed
    FROM plans LEFT JOIN (SELECT plan_id, count(*) AS n FROM plan_categories GROUP BY plan_id) c ON c.plan_id = plans.id""",
    "plans", "plan_categories",
)
def quality_score(r):
    n = r("plan_categories").groupBy(F.col("plan_id").alias("id")).agg(F.count("*").alias("n"))
    # Of a text only its being there counts, so no more than its first character moves.
    rows = r("plans")
    rows = rows.withColumns({c: F.left(c, F.lit(1)) for c, t in rows.dtypes if t == "string"}).join(n, "id", "left")
    return rows.select("id", normalize.agenda_quality(F.coalesce("n", F.lit(0))).alias("agenda"), normalize.feed_quality(F.coalesce("n", F.lit(0))).alias("feed"))


@query(
    f"""SELECT id, {tk("original_title")} || '|' || {k("municipality")} || '|' || coalesce(start_date, CASE WHEN permanent = 1 THEN 'permanent' ELSE 'sense-data' END) AS agenda,
    'feed|' || {tk("original_title")} || '|' || {k("municipality")} || '|' || {k("venue_name")} || coalesce('|' || start_date, '') AS feed FROM plans""",
    "plans",
)
def fingerprints(r):
    return r("plans").select("id", normalize.agenda_fingerprint().alias("agenda"), normalize.feed_fingerprint().alias("feed"))


@plain("SELECT event_id, event_type || '@' || substr(sha256('{\"k\":' || (props ->> '$.k') || '}'), 1, 16) AS identity FROM events")
def payload_identity(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", normalize.payload_identity(F.col("event_type"), F.col("props")).alias("identity"))


# ---- feed ------------------------------------------------------------------------------------

BRAND = "Box"
BUCKET = "CASE WHEN source IN ('trium', 'mfx-es') AND official_seller AND coalesce(brand_name = 'Box', false) THEN 'accepted' WHEN source = 'universe' THEN 'universe' WHEN source = 'mfx-external' THEN 'mfx-external' ELSE 'other' END"
HORIZON = "CASE WHEN end_date < start_date THEN 'invalid' WHEN end_date >= '2024-01-05' AND start_date <= '2024-01-25' THEN 'accepted' ELSE 'out' END"
PLACE = f"CASE WHEN {k('state')} IN ('girona', 'gerona') OR substr(postal_code, 1, 2) = '17' THEN 'Girona' END"
CONFIRMED = f"upper(country) = 'ES' AND ({PLACE}) IS NOT NULL AND coalesce(latitude, 0) BETWEEN 40.45 AND 42.95 AND longitude BETWEEN 0 AND 3.45"
REASON = f"""CASE WHEN {BUCKET} <> 'accepted' THEN 'source:' || {BUCKET} WHEN {HORIZON} = 'invalid' THEN 'dates:invalid' WHEN {HORIZON} = 'out' THEN 'dates:out'
  WHEN NOT ({CONFIRMED}) THEN 'territory' WHEN event_id IN ('17', '1234') THEN 'denied' END"""


@query(f"SELECT coalesce({REASON}, 'kept') AS reason, count(*) AS n FROM feed GROUP BY 1", "feed")
def feed_funnel(r):
    return feeds.funnel_counts(feeds.funnel(r("feed"), "2024-01-05", "2024-01-25", feeds.Policy(BRAND, denied=("17", "1234"))))


@query(f"SELECT event_id, {BUCKET} AS bucket, {HORIZON} AS horizon, CAST({CONFIRMED} AS INT) AS confirmed, {PLACE} AS province FROM feed", "feed")
def feed_policies(r):
    place = feeds.territory(F.col("country"), F.col("state"), F.col("postal_code"), F.col("latitude"), F.col("longitude"))
    return r("feed").withColumn("p", place).select("event_id", feeds.source_bucket(feeds.Policy(BRAND)).alias("bucket"), feeds.horizon_class("2024-01-05", "2024-01-25").alias("horizon"), F.col("p.confirmed").cast("int").alias("confirmed"), "p.province")


KEYS = f"{tk('title')} AS title_k, coalesce(nullif(venue_id, ''), {k('venue_name')}) AS venue_k, {k('municipality')} AS place_k"


@query(f"SELECT title_k, venue_k, place_k, start_date, max(end_date) AS end_date, array_to_string(list_sort(list(DISTINCT nullif(start_time, ''))), ',') AS hours, min(pos) AS first_pos, arg_min(venue_name, pos) AS venue_name, count(*) AS records FROM (SELECT *, {KEYS} FROM feed) t GROUP BY ALL", "feed")
def daily_sessions(r):
    return feeds.daily_sessions(r("feed")).withColumn("hours", F.array_join("hours", ","))


@query(
    f"""SELECT title_k, venue_k, place_k, CAST(sum(n) AS BIGINT) AS sessions, count(*) AS active_days, date_diff('day', CAST(min(start_date) AS DATE), CAST(max(start_date) AS DATE)) + 1 AS span_days, min(start_date) AS first_date, max(start_date) AS last_date
    FROM (SELECT title_k, venue_k, place_k, start_date, count(*) AS n FROM (SELECT *, {KEYS} FROM feed) t GROUP BY ALL) d GROUP BY title_k, venue_k, place_k
    HAVING sum(n) >= 80 AND count(*) >= 21 AND span_days >= 28 AND sum(n) / count(*) >= 4 AND count(*) FILTER (n > 1) / count(*) >= 0.75 AND count(*) / span_days >= 0.6""",
    "feed",
)
def recurring_inventory(r):
    return feeds.recurring_inventory(r("feed")).drop("title", "venue_name").withColumn("span_days", F.col("span_days").cast("long"))


@query(
    f"""SELECT event_id, type, main_event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY type, m_pos) AS n FROM (
      SELECT a.event_id, CASE WHEN a.vip THEN 'PACKAGE_VARIANT' ELSE 'PRODUCT_VARIANT' END AS type, b.event_id AS main_event_id, b.pos AS m_pos
      FROM (SELECT *, {KEYS}, contains(title, '| Paquetes VIP') AS vip, starts_with(title, 'Upgrade ') AS extra FROM feed) a JOIN (SELECT *, {KEYS} FROM feed) b
      ON a.pos <> b.pos AND a.venue_k = b.venue_k AND a.place_k = b.place_k AND a.start_date = b.start_date AND a.venue_k <> ''
      WHERE (a.vip AND a.start_time = b.start_time AND {tk("replace(a.title, '| Paquetes VIP', '')")} = b.title_k)
        OR (a.extra AND (contains({tk("replace(a.title, 'Upgrade', ' ')")}, b.title_k) OR contains(b.title_k, {tk("replace(a.title, 'Upgrade', ' ')")}))))) t WHERE n = 1""",
    "feed",
)
def product_variants(r):
    return feeds.product_variants(r("feed"))


@query(
    f"""SELECT a.id, min(CASE WHEN sure THEN c_id END) AS confirmed, count(*) FILTER (NOT sure AND (first_sure IS NULL OR c_id < first_sure)) AS possible FROM (
      SELECT a.id, c.id AS c_id, sure, min(CASE WHEN sure THEN c.id END) OVER (PARTITION BY a.id) AS first_sure FROM (
        SELECT a.id, c.id AS cid, ({k("c.venue_name")} <> '' AND {k("c.venue_name")} = {k("a.venue_name")}) OR ({k("c.address")} <> '' AND {k("c.address")} = {k("a.address")})
          OR coalesce(abs(a.latitude - c.latitude) <= 0.002 AND abs(a.longitude - c.longitude) <= 0.002, false) AS sure
        FROM plans a JOIN plans c ON a.start_date = c.start_date AND {nc("a.municipality")} = {nc("c.municipality")} AND {tk("a.original_title")} = {tk("c.original_title")}
        WHERE a.id % 2 = 0 AND c.id % 2 = 1 AND a.municipality <> '') a JOIN plans c ON c.id = a.cid) a GROUP BY a.id""",
    "plans",
)
def cross_source_match(r):
    plans = r("plans")
    rows = feeds.cross_source_matches(plans.where("id % 2 = 0"), plans.where("id % 2 = 1"))
    return rows.select("id", "confirmed", F.col("n_possible").alias("possible"))


# ---- state -----------------------------------------------------------------------------------

LIVE = f"SELECT ps.* FROM plan_sources ps JOIN plans p ON p.id = ps.plan_id WHERE ps.source_id = 7 AND {END} >= '{TODAY}' AND start_date <= '{LAST}'"


def _candidates(r) -> DataFrame:
    return state.reconciliation_candidates(r("plan_sources"), r("plans"), 7, TODAY, LAST)


def _seen(r) -> DataFrame:
    """A feed that lacks one record in twenty."""
    return r("plans").where("id % 20 <> 0").select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("event_id"))


@query(f"SELECT id, plan_id FROM ({LIVE}) c WHERE source_record_id NOT IN (SELECT 'r' || id FROM plans WHERE id % 20 <> 0)", "plans", "plan_sources")
def reconcile_missing(r):
    return state.missing_links(_candidates(r), _seen(r)).select("id", "plan_id")


@query(
    f"""SELECT p.id, CASE WHEN l.plan_id IS NULL THEN p.status WHEN rest.n > 0 THEN CASE WHEN p.status = 'inactive' THEN 'active' ELSE p.status END ELSE 'inactive' END AS status
    FROM plans p LEFT JOIN (SELECT DISTINCT plan_id FROM plan_sources WHERE source_id = 7) l ON l.plan_id = p.id
    LEFT JOIN (SELECT plan_id, count(*) AS n FROM plan_sources WHERE source_id <> 7 GROUP BY plan_id) rest ON rest.plan_id = p.id""",
    "plans", "plan_sources",
)
def plan_status_after_removal(r):
    links = r("plan_sources")
    after = state.remove_links({"plans": r("plans"), "plan_sources": links}, links.where("source_id = 7").select("id", "plan_id"), "1998-06-15T12:00:00.000Z")
    return after["plans"].select("id", "status")


def _incoming(r) -> DataFrame:
    """Source 7's records again: some with other payloads, some unknown, with plans that are known or not."""
    rows = r("plans")
    fingerprint = F.when(F.col("id") % 2 == 0, F.col("fingerprint")).otherwise(F.concat(F.lit("new-"), (F.col("id") % 1000).cast("string")))
    payload = F.concat(F.lit('{"v":'), (F.col("id") % F.when(F.col("id") % 4 == 0, 10).otherwise(7)).cast("string"), F.lit("}"))
    return rows.select(F.col("id").alias("pos"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("record_id"), fingerprint.alias("fingerprint"), payload.alias("payload"))


INCOMING = """incoming AS (SELECT id AS pos, 'r' || id AS record_id, CASE WHEN id % 2 = 0 THEN fingerprint ELSE 'new-' || (id % 1000) END AS fingerprint,
  '{"v":' || (id % CASE WHEN id % 4 = 0 THEN 10 ELSE 7 END) || '}' AS payload FROM plans)"""
OUTCOMES = f"""WITH {INCOMING}, prints AS (SELECT fingerprint, min(id) AS id FROM plans GROUP BY fingerprint),
joined AS (SELECT i.*, ps.plan_id AS known, ps.source_payload_json AS old, p.id AS print FROM incoming i
  LEFT JOIN plan_sources ps ON ps.source_id = 7 AND ps.source_record_id = i.record_id LEFT JOIN prints p ON p.fingerprint = i.fingerprint),
firsts AS (SELECT fingerprint, min(pos) AS pos FROM joined WHERE known IS NULL AND print IS NULL GROUP BY fingerprint),
ids AS (SELECT fingerprint, (SELECT max(id) FROM plans) + row_number() OVER (ORDER BY pos) AS id FROM firsts)
SELECT j.pos, j.record_id, CASE WHEN known IS NOT NULL AND payload = old THEN 'skipped' WHEN known IS NULL AND print IS NULL AND f.pos = j.pos THEN 'inserted' ELSE 'updated' END AS outcome,
  coalesce(known, print, ids.id) AS plan_id FROM joined j LEFT JOIN firsts f ON f.fingerprint = j.fingerprint LEFT JOIN ids ON ids.fingerprint = j.fingerprint"""


@query(f"SELECT * FROM ({OUTCOMES}) t", "plans", "plan_sources")
def upsert_outcome(r):
    return state.upsert_outcomes(_incoming(r), r("plan_sources"), r("plans"), 7).select("pos", "record_id", "outcome", "plan_id")


@query(f"SELECT count(*) AS fetched, count(*) FILTER (outcome = 'inserted') AS inserted, count(*) FILTER (outcome = 'updated') AS updated, count(*) FILTER (outcome = 'skipped') AS skipped, CAST(0 AS BIGINT) AS invalid, CAST(0 AS BIGINT) AS errors FROM ({OUTCOMES}) t", "plans", "plan_sources")
def run_ledger(r):
    return state.run_counts(state.upsert_outcomes(_incoming(r), r("plan_sources"), r("plans"), 7))


@query(
    """SELECT fingerprint, arg_min(title_es, id) FILTER (title_es IS NOT NULL) AS title_es, arg_min(venue_name, id) FILTER (venue_name IS NOT NULL) AS venue_name,
    arg_min(latitude, id) FILTER (latitude IS NOT NULL) AS latitude, max(quality_score) AS quality_score FROM plans GROUP BY fingerprint""",
    "plans",
)
def fill_merge(r):
    folded = state.fold_fills(r("plans"), "fingerprint", "id", ["title_es", "venue_name", "latitude"])
    return folded.select("fingerprint", "title_es", "venue_name", "latitude", "quality_score")


@query("SELECT plan_id, category_id FROM plan_categories UNION SELECT p.id, c.id FROM plans p JOIN categories c ON c.slug = CASE p.id % 4 WHEN 0 THEN 'promo' WHEN 1 THEN 'large' WHEN 2 THEN 'unknown' ELSE 'small' END", "plans", "plan_categories", "categories")
def link_categories(r):
    slug = F.when(F.col("id") % 4 == 0, "promo").when(F.col("id") % 4 == 1, "large").when(F.col("id") % 4 == 2, "unknown").otherwise("small")
    return state.link_categories(r("plan_categories"), r("plans").select(F.col("id").alias("plan_id"), slug.alias("slug")), r("categories"))


EXPIRED = f"permanent <> 1 AND {END} IS NOT NULL AND {END} < '1998-06-15'"


@query(
    f"""SELECT policy, relation, n FROM (
      SELECT p.policy, 'plans' AS relation, count(*) AS n FROM doomed p GROUP BY 1 UNION ALL
      SELECT p.policy, 'plan_sources', count(s.id) FROM doomed p LEFT JOIN plan_sources s ON s.plan_id = p.id GROUP BY 1 UNION ALL
      SELECT p.policy, 'plan_categories', count(c.plan_id) FROM doomed p LEFT JOIN plan_categories c ON c.plan_id = p.id GROUP BY 1) t""".replace(
        "doomed", f"(SELECT id, CASE WHEN ({ISSUE}) IS NOT NULL THEN 'invalid' WHEN {EXPIRED} THEN 'expired' ELSE 'outside' END AS policy FROM plans WHERE ({ISSUE}) IS NOT NULL OR ({EXPIRED}) OR ({OUTSIDE}))"
    ),
    "plans", "plan_sources", "plan_categories",
)
def purge_cascade(r):
    return state.purge_old({n: r(n) for n in ("plans", "plan_sources", "plan_categories")}, NOW)[1]


@query(
    """SELECT p.id, p.inactive_at, coalesce(n, 0) AS n_sources,
    CASE WHEN coalesce(n, 0) > 0 THEN 'has-source' WHEN p.inactive_at IS NULL THEN 'no-timestamp' WHEN p.inactive_at > '1998-06-08T12:00:00.000Z' THEN 'too-recent' ELSE 'eligible' END AS reason,
    CAST(floor(date_diff('second', CAST(p.inactive_at AS TIMESTAMP), TIMESTAMP '1998-06-15 12:00:00') / 86400.0) AS BIGINT) AS days
    FROM plans p LEFT JOIN (SELECT plan_id, count(*) AS n FROM plan_sources GROUP BY plan_id) s ON s.plan_id = p.id WHERE p.status = 'inactive'""",
    "plans", "plan_sources",
)
def inactive_audit(r):
    return state.inactive_audit(r("plans"), r("plan_sources"), NOW)


GOOD_IMAGE = "starts_with(url, 'https:') AND width BETWEEN 1 AND 2048 AND height BETWEEN 1 AND 2048"


@query(
    f"""SELECT plan_id, role, id FROM (SELECT i.plan_id, r.role, i.id, row_number() OVER (PARTITION BY i.plan_id, r.role
      ORDER BY CASE WHEN ratio = '16_9' THEN 0 ELSE 1 END, is_fallback, abs(width - w) + abs(height - h), width, url, i.id) AS n
    FROM (SELECT images.*, ps.plan_id FROM images JOIN plan_sources ps ON ps.id = plan_source_id WHERE images.role = 'card' AND {GOOD_IMAGE}) i
    CROSS JOIN (VALUES ('card', 640, 360), ('detail', 1136, 639)) r(role, w, h)) t WHERE n = 1""",
    "images", "plan_sources",
)
def image_best_per_role(r):
    owned = r("images").where("role = 'card'").drop("role").join(r("plan_sources").select(F.col("id").alias("plan_source_id"), "plan_id"), "plan_source_id")
    return state.best_image_per_role(owned, "plan_id").select("plan_id", "role", "id")


@query(
    """SELECT coalesce(o.plan_source_id, n.plan_source_id) AS plan_source_id, coalesce(o.role, n.role) AS role,
    CASE WHEN o.role IS NULL THEN 'created' WHEN n.role IS NULL THEN 'removed' WHEN o.width = n.width THEN 'unchanged' ELSE 'updated' END AS action
    FROM images o FULL JOIN (SELECT plan_source_id, CASE WHEN id % 20 = 0 THEN 'extra' ELSE role END AS role, CASE WHEN id % 3 = 0 THEN width + 1 ELSE width END AS width FROM images) n
    ON o.plan_source_id = n.plan_source_id AND o.role = n.role""",
    "images",
)
def image_upsert_actions(r):
    """All images again: some wider, one in twenty in another role."""
    ident = F.col("id")
    width, role = F.when(ident % 3 == 0, F.col("width") + 1).otherwise(F.col("width")), F.when(ident % 20 == 0, "extra").otherwise(F.col("role"))
    return state.image_actions(r("images"), r("images").withColumns({"width": width, "role": role}))


@query(
    """SELECT ps.id, coalesce(n, 0) AS n_images FROM plan_sources ps LEFT JOIN (SELECT plan_source_id, count(*) AS n, min(last_seen_at) AS oldest FROM images GROUP BY 1) i ON i.plan_source_id = ps.id
    WHERE coalesce(n, 0) < 2 OR oldest IS NULL OR oldest <= '1998-06-13'""",
    "plan_sources", "images",
)
def image_refresh_due(r):
    return state.images_due(r("plan_sources").select("id"), r("images"), "1998-06-13").select("id", "n_images")


FILES = "SELECT event_id AS image_id, CAST(100 + event_id % 900 AS BIGINT) AS size, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS fetched_at FROM events"


@plain(
    f"""SELECT image_id, size, fetched_at, CASE WHEN image_id % 10 = 3 THEN 'orphan' WHEN old THEN 'expired' WHEN newer > 1000000 THEN 'evicted' ELSE 'kept' END AS action FROM (
    SELECT *, sum(CASE WHEN image_id % 10 <> 3 AND NOT old THEN size ELSE 0 END) OVER (ORDER BY fetched_at DESC, image_id DESC ROWS UNBOUNDED PRECEDING) AS newer FROM (
    SELECT *, CAST(fetched_at AS TIMESTAMP) < TIMESTAMP '2024-01-10 00:00:00' AS old FROM ({FILES}) f) a) t"""
)
def cache_eviction(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    files = events.select(F.col("event_id").alias("image_id"), (F.lit(100) + F.col("event_id") % 900).alias("size"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("fetched_at"))
    valid = files.where("image_id % 10 <> 3").select("image_id")
    return state.cache_evictions(files, "2024-01-20T00:00:00", 240, 1_000_000, valid)


@query(
    """SELECT id, key, CASE WHEN enabled <> 1 THEN 'disabled' WHEN allows_data_reuse <> 1 THEN 'no reuse' WHEN license_name = '' THEN 'review incomplete'
    WHEN requires_attribution = 1 AND coalesce(attribution_text, '') = '' THEN 'attribution missing' END AS reason, row_number() OVER (ORDER BY lower(name), id) AS rank FROM sources""",
    "sources",
)
def source_gate(r):
    """The sources in order, each with the reason that keeps it out."""
    rows = r("sources").withColumn("reason", predicates.license_reason())
    return ranked(rows.select("id", "key", "reason", "name"), X.nocase(F.col("name")), "id").drop("name")
