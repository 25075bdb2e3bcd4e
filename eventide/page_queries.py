"""Registered queries of whole answers (a list, a plan), of the stored search index and of stored changes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.session import settled, shared_folder
from .operators import search
from .plans.schemas import TABLES
from .queries import FOUND, ORDERS, OUTCOMES, TITLE, _incoming, query, shown
from .record_queries import STAMP
from .sources.buckets import BucketStore
from .sources.search_index import SearchIndex, write_index
from .sources.snapshot import remove_folder
from .testdata import NOW

FLAGS = {"free": "is_free", "family": "family_friendly", "indoor": "indoor", "outdoor": "outdoor", "permanent": "permanent", "featured": "featured", "image_reuse_allowed": "image_reuse_allowed"}
PLAIN = [c for c in search.LISTED if c not in ("title", "subtitle", "description", "image_url", *FLAGS.values())]


def _texts(lang: str) -> str:
    other = "es" if lang == "ca" else "ca"
    return f"""{TITLE[lang]} AS title, coalesce(nullif(subtitle_{lang}, ''), nullif(subtitle_{other}, '')) AS subtitle,
  coalesce(nullif(description_{lang}, ''), nullif(original_description, ''), nullif(description_{other}, '')) AS description"""


def _categories(lang: str) -> str:
    other = "es" if lang == "ca" else "ca"
    return f"""coalesce((SELECT string_agg(concat_ws('|', slug, coalesce(nullif(name_{lang}, ''), nullif(name_{other}, '')), name_ca, name_es, group_name, icon), ',' ORDER BY slug)
  FROM plan_categories pc JOIN categories c ON c.id = pc.category_id WHERE pc.plan_id = p.id), '') AS category_list"""


def _images(role: str) -> str:
    return f"""(SELECT ps.plan_id, im.id AS image_id, width AS image_width, height AS image_height, nullif(attribution, '') AS image_attribution,
    row_number() OVER (PARTITION BY ps.plan_id ORDER BY is_fallback, im.last_seen_at DESC NULLS LAST, im.id) AS n
  FROM images im JOIN plan_sources ps ON ps.id = im.plan_source_id JOIN sources s ON s.id = ps.source_id WHERE im.role = '{role}' AND s.key = 'feed' AND s.enabled = 1)"""


def _flags() -> str:
    return ", ".join(f"{c} = 1 AS {n}" if n in ("free", "family", "indoor", "outdoor") else f"coalesce({c} = 1, FALSE) AS {n}" for n, c in FLAGS.items())


def _state(r) -> dict[str, DataFrame]:
    return {n: r(n) for n in ("plans", "plan_sources", "plan_categories", "categories", "sources", "images")}


def _flat(rows: DataFrame) -> list:
    """Lists and structs of an answer as text and columns."""
    named = lambda c: F.concat_ws("|", c["slug"], c["name"], c["name_ca"], c["name_es"], c["group_name"], c["icon"])
    lists = F.array_join(F.transform("categories", named), ",").alias("category_list")
    return [lists, F.substring_index("image.url", "/", -1).cast("long").alias("image_id"), F.col("image.width").alias("image_width"), F.col("image.height").alias("image_height"), F.col("image.attribution").alias("image_attribution")]


RELATIONS = ("plans", "plan_categories", "categories", "images", "plan_sources", "sources")


@query(
    f""", page AS (SELECT *, row_number() OVER (ORDER BY {ORDERS["search_default_page"][2]}) AS rank FROM visible WHERE {FOUND["search_range"][1]} QUALIFY rank > 20 AND rank <= 40)
    SELECT CAST(rank AS INT) AS rank, {", ".join(f"p.{c}" for c in PLAIN)}, {_texts("ca")}, CASE WHEN image_reuse_allowed = 1 THEN image_url END AS image_url, {_flags()}, {_categories("ca")}, image_id, image_width, image_height, image_attribution,
      (SELECT count(*) FROM visible WHERE {FOUND["search_range"][1]}) AS total, (SELECT CAST(ceil(count(*) / 20.0) AS BIGINT) FROM visible WHERE {FOUND["search_range"][1]}) AS pages
    FROM page p LEFT JOIN {_images("card")} i ON i.plan_id = p.id AND i.n = 1""",
    *RELATIONS,
)
def list_composed(r):
    """The second page of a list with all that a reader gets."""
    rows, envelope = search.listing(_state(r), ORDERS["search_default_page"][0], NOW, "feed")
    both = rows.crossJoin(F.broadcast(envelope.select("total", "pages")))
    return both.select("rank", *PLAIN, "title", "subtitle", "description", "image_url", *FLAGS, *_flat(rows), "total", "pages")


DETAIL_ID = "(SELECT max(v.id) FROM visible v WHERE EXISTS (SELECT 1 FROM plan_sources ps JOIN images im ON im.plan_source_id = ps.id JOIN sources s ON s.id = ps.source_id WHERE ps.plan_id = v.id AND im.role = 'detail' AND s.key = 'feed' AND s.enabled = 1))"
DETAILED = [*PLAIN, "original_title", "original_description", "title_ca", "title_es", "recommended_months", "status", "created_at", "updated_at", "inactive_at"]


@query(
    f"""SELECT {", ".join(f"p.{c}" for c in DETAILED)}, {_texts("es")}, CASE WHEN image_reuse_allowed = 1 THEN image_url END AS image_url, {_flags()}, {_categories("es")}, image_id, image_width, image_height, image_attribution,
      (SELECT string_agg(concat_ws('|', s.name, s.publisher, ps.source_url, s.attribution_text, s.license_name, s.license_url, ps.source_updated_at, ps.imported_at), ',' ORDER BY s.name, ps.source_updated_at DESC, ps.imported_at DESC, ps.id)
        FROM plan_sources ps JOIN sources s ON s.id = ps.source_id WHERE ps.plan_id = p.id) AS source_list, FALSE AS leaks
    FROM (SELECT * FROM visible WHERE id = {DETAIL_ID}) p LEFT JOIN {_images("detail")} i ON i.plan_id = p.id AND i.n = 1""",
    *RELATIONS,
)
def detail_composed(r):
    """The last plan with a detail image, in Spanish, with categories, sources and the image."""
    st = _state(r)
    held = search.best_images(st["images"], st["plan_sources"], st["sources"], "detail", "feed")
    ident = shown(r).join(held, "id", "left_semi").agg(F.max("id")).first()[0]
    row = search.detailed(st, ident, NOW, "feed", "es")
    named = lambda s: F.concat_ws("|", s["name"], s["publisher"], s["source_url"], s["attribution_text"], s["license_name"], s["license_url"], s["source_updated_at"], s["imported_at"])
    leaks = any(c in row.columns for c in ("fingerprint", "is_free", "family_friendly"))
    return row.select(*DETAILED, "title", "subtitle", "description", "image_url", *FLAGS, *_flat(row), F.array_join(F.transform("sources", named), ",").alias("source_list"), F.lit(leaks).alias("leaks"))


def _indexed(r, find) -> DataFrame:
    """What ``find`` makes of the plans and their index, which is written for it and removed again."""
    plans = r("plans")
    folder = f"{shared_folder(plans.sparkSession)}/index-{uuid.uuid4().hex}"
    write_index(plans, folder)
    rows = settled(find(plans, SearchIndex(plans.sparkSession, folder)))
    remove_folder(plans.sparkSession, folder)
    return rows


@query(f"SELECT id, start_date, quality_score FROM visible WHERE {FOUND['search_text'][1]}", "plans")
def search_text_indexed(r):
    """``search_text`` by the stored postings."""
    return _indexed(r, lambda plans, index: search.matching(plans, FOUND["search_text"][0], NOW, index=index).select("id", "start_date", "quality_score"))


@query("SELECT id FROM plans WHERE contains(lower(strip_accents(concat_ws(' ', municipality, comarca, province))), 'africa')", "plans")
def combobox_indexed(r):
    return _indexed(r, lambda plans, index: index.places("Nació Tres", {"nacio tres": "africa"}))


#: A record's plan becomes active: overwritten by a known record, filled by another, or woken by an equal one.
@query(
    f""", outcomes AS ({OUTCOMES}), hit AS (SELECT plan_id, count(*) FILTER (outcome <> 'skipped') AS n, bool_or(outcome = 'updated' AND pos IN (SELECT CAST(substr(source_record_id, 2) AS BIGINT) FROM plan_sources WHERE source_id = 7)) AS over FROM outcomes GROUP BY plan_id)
    SELECT p.id, CASE WHEN h.over OR (h.plan_id IS NOT NULL AND p.status = 'inactive') THEN 'active' ELSE p.status END AS status, coalesce(h.n > 0 OR (h.plan_id IS NOT NULL AND p.status = 'inactive'), FALSE) AS touched
    FROM (SELECT id, status FROM plans UNION ALL SELECT plan_id, 'active' FROM outcomes WHERE outcome = 'inserted') p LEFT JOIN hit h ON h.plan_id = p.id""",
    "plans", "plan_sources",
)
def stored_upsert(r):
    """A batch of active records for a store in buckets: the plans as the next version has them."""
    plans, links = r("plans"), r("plan_sources")
    spark = plans.sparkSession
    root = f"{shared_folder(spark)}/buckets-{uuid.uuid4().hex}"
    st = {n: spark.createDataFrame([], s) for n, s in TABLES.items()} | {"plans": plans, "plan_sources": links}
    incoming = _incoming(r).withColumns({"status": F.lit("active"), "quality_score": F.lit(0), "category_slugs": F.array().cast("array<string>")})
    after = BucketStore.create(spark, st, root, buckets=8).upsert(incoming, 7, STAMP)[0].read(texts=False)["plans"]
    rows = settled(after.select("id", "status", F.coalesce(F.col("updated_at") == STAMP, F.lit(False)).alias("touched")))
    remove_folder(spark, root)
    return rows
