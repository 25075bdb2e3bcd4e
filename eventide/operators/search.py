"""Catalogue search: filters, orders, pages, nested decoration, detail and facets."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date, datetime
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import settled
from ..functions.text import first_nonempty, nocase, xml_escape
from . import predicates as P

if TYPE_CHECKING:
    from ..sources.search_index import SearchIndex

#: Rows of a page (a few hundred at most by ``Filters``) are small enough to send everywhere.
MAX_LIMIT, MAX_PAGE = 100, 200
SORTS = ("date", "quality", "title")
EDITORIALS = ("home-weekend", "home-upcoming")


class InvalidQuery(ValueError):
    """A query parameter is unknown, malformed or contradicts another."""


@dataclass(frozen=True)
class Filters:
    """Checked filters of a list query."""

    q: str | None = None
    province: str | None = None
    comarca: str | None = None
    municipality: str | None = None
    kind: str | None = None
    free: int | None = None
    family: int | None = None
    indoor: int | None = None
    outdoor: int | None = None
    permanent: int | None = None
    categories: tuple[str, ...] = field(default=())
    date: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    editorial: str | None = None
    sort: str = "date"
    lang: str = "ca"
    page: int = 1
    limit: int = 20


_FLAGS = ("free", "family", "indoor", "outdoor", "permanent")
_NAMES = {"dateFrom": "date_from", "dateTo": "date_to", "category": "categories"}
_SHARED = ("q", "province", "comarca", "municipality", "category", "date", "dateFrom", "dateTo", "free", "family")


def parse_filters(query: dict[str, str | list[str]]) -> Filters:
    """Checks the parameters of a list query; raises InvalidQuery."""
    out: dict = {}
    for name, value in query.items():
        target = _NAMES.get(name, name)
        if target not in Filters.__dataclass_fields__:
            raise InvalidQuery(f"unknown parameter: {name}")
        if isinstance(value, list):
            raise InvalidQuery(f"{name} stands more than once")
        if name == "q" and not value.strip():
            continue
        if not value.strip() or len(value) > (100 if name == "q" else 120):
            raise InvalidQuery(f"{name} is empty or too long")
        if target in _FLAGS:
            if value not in ("true", "false"):
                raise InvalidQuery(f"{name} must be true or false")
            out[target] = int(value == "true")
        elif target in ("date", "date_from", "date_to"):
            try:
                good = re.fullmatch(r"\d{4}-\d{2}-\d{2}", value) and date.fromisoformat(value)
            except ValueError:
                good = None
            if not good:
                raise InvalidQuery(f"{name} is no date")
            out[target] = value
        elif target in ("page", "limit"):
            most = MAX_PAGE if target == "page" else MAX_LIMIT
            if not re.fullmatch(r"\d{1,9}", value) or not 1 <= int(value) <= most:
                raise InvalidQuery(f"{name} must be 1 to {most}")
            out[target] = int(value)
        elif target == "categories":
            out[target] = tuple(dict.fromkeys(x.strip() for x in value.split(",") if x.strip()))
        else:
            out[target] = value if target == "q" else value.strip()
    for name, allowed in (("sort", SORTS), ("editorial", EDITORIALS), ("lang", ("ca", "es"))):
        if name in out and out[name] not in allowed:
            raise InvalidQuery(f"{name} must be one of {', '.join(allowed)}")
    if "date" in out and ("date_from" in out or "date_to" in out):
        raise InvalidQuery("date excludes dateFrom and dateTo")
    if out.get("date_from") and out.get("date_to") and out["date_from"] > out["date_to"]:
        raise InvalidQuery("dateFrom is after dateTo")
    if out.get("editorial") == "home-weekend" and not (out.get("date_from") and out.get("date_to")):
        raise InvalidQuery("home-weekend needs dateFrom and dateTo")
    if out.get("editorial") == "home-upcoming" and (not out.get("date_from") or out.get("date_to")):
        raise InvalidQuery("home-upcoming needs dateFrom alone")
    if "editorial" in out and "sort" in out:
        raise InvalidQuery("editorial excludes sort")
    return Filters(**out)


def shared_filters(query: dict[str, str]) -> dict[str, str]:
    """The parameters that a link to a search keeps: known ones that are neither empty nor false."""
    return {k: query[k] for k in _SHARED if query.get(k) not in (None, "", "false")}


def localized(lang: str) -> dict[str, Column]:
    """Title, subtitle and description in a language, with its fallbacks."""
    other = "ca" if lang == "es" else "es"
    c = F.col
    return {
        "title": first_nonempty(c(f"title_{lang}"), c("original_title"), c(f"title_{other}")),
        "subtitle": first_nonempty(c(f"subtitle_{lang}"), c(f"subtitle_{other}")),
        "description": first_nonempty(c(f"description_{lang}"), c("original_description"), c(f"description_{other}")),
    }


def matching(plans: DataFrame, filters: Filters, now: datetime, links: DataFrame | None = None, categories: DataFrame | None = None, retention_days: int = 0, index: SearchIndex | None = None) -> DataFrame:
    """Visible plans that pass the filters.  ``links`` and ``categories`` are only read for a category filter.

    With the ``index`` of a snapshot, a text query reads its postings instead of the plans' texts.
    """
    where = P.visible(now, retention_days)
    if filters.q is not None and index is not None:
        plans = plans.join(index.search(filters.q), "id", "left_semi")
    elif filters.q is not None:
        where = where & P.text_search(filters.q)
    for name in ("municipality", "comarca"):
        if getattr(filters, name) is not None:
            where = where & P.same_key(name, getattr(filters, name))
    for name in ("province", "kind"):
        if getattr(filters, name) is not None:
            where = where & P.same_nocase(name, getattr(filters, name))
    for name, column in (("free", "is_free"), ("family", "family_friendly"), ("indoor", "indoor"), ("outdoor", "outdoor"), ("permanent", "permanent")):
        if getattr(filters, name) is not None:
            where = where & (F.col(column) == getattr(filters, name))
    if filters.editorial == "home-upcoming":
        where = where & P.starts_from(filters.date_from)
    elif filters.date:
        where = where & P.during(filters.date, filters.date)
    elif filters.date_from or filters.date_to:
        closed = filters.date_from and filters.date_to
        span = P.during(filters.date_from, filters.date_to)
        where = where & (span & ((F.col("permanent") == 1) | (F.col("start_date").isNotNull() & F.col("end_date").isNotNull())) if closed else span)
    out = plans.where(where)
    if filters.categories:
        wanted = categories.where(F.col("slug").isin(list(filters.categories))).select(F.col("id").alias("category_id"))
        out = out.join(links.join(wanted, "category_id", "left_semi").select(F.col("plan_id").alias("id")), "id", "left_semi")
    return out


def order(filters: Filters) -> list[Column]:
    """Sort keys; nulls first in ascending order unless said otherwise."""
    start, ident = F.col("start_date"), F.col("id")
    if filters.editorial == "home-weekend":
        inside = start.between(filters.date_from, filters.date_to)
        return [F.when(inside, 0).otherwise(1), F.when(inside, start).asc_nulls_first(), F.when(start < filters.date_from, start).desc_nulls_last(), ident]
    if filters.editorial == "home-upcoming":
        return [start.asc_nulls_first(), ident]
    if filters.sort == "quality":
        return [F.col("quality_score").desc(), start.isNull().cast("int"), start, ident]
    if filters.sort == "title":
        return [nocase(localized(filters.lang)["title"]).asc_nulls_first(), ident]
    if filters.date:
        once = F.col("permanent") == 0
        return [F.when(once & (start == filters.date), 0).when(once, 1).otherwise(2), start.desc_nulls_last(), ident]
    return [F.col("permanent"), start.isNull().cast("int"), start, ident]


LISTED = [
    "id", "kind", "original_language", "title", "subtitle", "description", "start_date", "end_date", "schedule_text", "permanent",
    "price_text", "is_free", "province", "comarca", "municipality", "locality", "address", "postal_code", "venue_name", "latitude",
    "longitude", "website_url", "ticket_url", "image_url", "image_reuse_allowed", "family_friendly", "indoor", "outdoor", "featured", "quality_score",
]


def page(found: DataFrame, filters: Filters) -> DataFrame:
    """The page's rows in order, localized, with ``rank`` (from 1 in the whole result)."""
    first = (filters.page - 1) * filters.limit
    rows = found.orderBy(*order(filters)).offset(first).limit(filters.limit)
    ranked = rows.withColumn("rank", F.row_number().over(Window.orderBy(*order(filters))) + first)
    return public(ranked.withColumns(localized(filters.lang)).select("rank", *LISTED))


def public(rows: DataFrame) -> DataFrame:
    """Flags as booleans (three-valued where unknown is possible); an image only where its reuse is allowed."""
    three = {"free": "is_free", "family": "family_friendly", "indoor": "indoor", "outdoor": "outdoor"}
    two = ("permanent", "featured", "image_reuse_allowed")
    return rows.withColumns(
        {n: F.col(c) == 1 for n, c in three.items()} | {n: F.coalesce(F.col(n) == 1, F.lit(False)) for n in two} | {"image_url": F.when(F.col("image_reuse_allowed") == 1, F.col("image_url"))}
    )


def envelope(found: DataFrame, filters: Filters) -> DataFrame:
    """One row: page, limit, total, pages."""
    return found.agg(F.count("*").alias("total")).select(
        F.lit(filters.page).alias("page"), F.lit(filters.limit).alias("limit"), "total", F.ceil(F.col("total") / filters.limit).alias("pages")
    )


def category_lists(rows: DataFrame, links: DataFrame, categories: DataFrame, lang: str = "ca") -> DataFrame:
    """``rows`` with ``categories``: structs by slug, an empty array if there are none."""
    other = "ca" if lang == "es" else "es"
    named = categories.select(F.col("id").alias("category_id"), "slug", first_nonempty(F.col(f"name_{lang}"), F.col(f"name_{other}")).alias("name"), "name_ca", "name_es", "group_name", "icon")
    mine = links.join(rows.select(F.col("id").alias("plan_id")), "plan_id", "left_semi").join(named, "category_id")
    lists = mine.groupBy(F.col("plan_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("slug", "name", "name_ca", "name_es", "group_name", "icon"))).alias("categories"))
    empty = F.array().cast(lists.schema["categories"].dataType)
    return rows.join(lists, "id", "left").withColumn("categories", F.coalesce("categories", empty))


def source_lists(rows: DataFrame, provenance: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with ``sources``: by name, latest update and latest import first."""
    mine = provenance.join(rows.select(F.col("id").alias("plan_id")), "plan_id", "left_semi").join(sources.select(F.col("id").alias("source_id"), "key", "name", "publisher", "attribution_text", "license_name", "license_url"), "source_id")
    rank = F.row_number().over(Window.partitionBy("plan_id").orderBy("name", F.col("source_updated_at").desc(), F.col("imported_at").desc(), "id"))
    one = F.struct(rank.alias("n"), "key", "name", "publisher", "attribution_text", "license_name", "license_url", "source_url", "source_updated_at", "imported_at")
    lists = mine.select("plan_id", one.alias("s")).groupBy(F.col("plan_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s.dropFields("n")).alias("sources"))
    return rows.join(lists, "id", "left")


def servable_images(images: DataFrame, provenance: DataFrame, sources: DataFrame, plans: DataFrame, controlled: str) -> DataFrame:
    """(id, url) of the images that may be served: of the controlled source, if it is enabled, and of an active plan."""
    allowed = sources.where((F.col("key") == controlled) & (F.col("enabled") == 1)).select(F.col("id").alias("source_id"))
    active = plans.where(F.col("status") == "active").select(F.col("id").alias("plan_id"))
    links = provenance.join(allowed, "source_id", "left_semi").join(active, "plan_id", "left_semi").select(F.col("id").alias("plan_source_id"))
    return images.join(links, "plan_source_id", "left_semi").select("id", "url")


def best_images(images: DataFrame, provenance: DataFrame, sources: DataFrame, role: str, controlled: str, url_prefix: str = "/api/media/") -> DataFrame:
    """(id, image): of a plan's images in this role from the controlled, enabled source the best one."""
    allowed = sources.where((F.col("key") == controlled) & (F.col("enabled") == 1)).select(F.col("id").alias("source_id"))
    owned = provenance.join(allowed, "source_id", "left_semi").select(F.col("id").alias("plan_source_id"), "plan_id")
    rank = F.row_number().over(Window.partitionBy("plan_id").orderBy("is_fallback", F.col("last_seen_at").desc(), "id"))
    best = images.where(F.col("role") == role).join(owned, "plan_source_id").withColumn("n", rank).where("n = 1")
    url = F.concat(F.lit(url_prefix), F.col("id").cast("string"))
    return best.select(F.col("plan_id").alias("id"), F.struct(url.alias("url"), "width", "height", F.nullif("attribution", F.lit("")).alias("attribution")).alias("image"))


def with_images(rows: DataFrame, best: DataFrame, enabled: bool = True) -> DataFrame:
    """``rows`` with ``image``, null where there is none or images are switched off."""
    if not enabled:
        return rows.withColumn("image", F.lit(None).cast(best.schema["image"].dataType))
    return rows.join(best, "id", "left")


def detail(plans: DataFrame, plan_id: int, now: datetime, lang: str = "ca", retention_days: int = 0) -> DataFrame:
    """The plan, if it is visible; without its fingerprint."""
    row = plans.where((F.col("id") == plan_id) & P.visible(now, retention_days))
    return public(row.withColumns(localized(lang))).drop("fingerprint", "is_free", "family_friendly")


State = dict[str, DataFrame]


def _around(rows: DataFrame, st: State) -> State:
    """What hangs on a page's plans; the page has MAX_LIMIT rows at most, so its ids go to all tasks."""
    ids = F.broadcast(rows.select(F.col("id").alias("plan_id")))
    return st | {"plan_categories": st["plan_categories"].join(ids, "plan_id", "left_semi"), "plan_sources": st["plan_sources"].join(ids, "plan_id", "left_semi")}


def _image(rows: DataFrame, st: State, role: str, controlled: str, enabled: bool) -> DataFrame:
    links = F.broadcast(st["plan_sources"].select(F.col("id").alias("plan_source_id")))
    images = st["images"].join(links, "plan_source_id", "left_semi")
    return with_images(rows, best_images(images, st["plan_sources"], st["sources"], role, controlled), enabled)


def listing(st: State, filters: Filters, now: datetime, controlled: str, images: bool = True, retention_days: int = 0, index: SearchIndex | None = None) -> tuple[DataFrame, DataFrame]:
    """A list as a reader gets it: the page's plans in order with categories and card image, and the envelope.

    The page is cut first; categories and images are then looked up for its plans alone.
    """
    found = matching(st["plans"], filters, now, st["plan_categories"], st["categories"], retention_days, index)
    rows = settled(page(found, filters))
    near = _around(rows, st)
    rows = category_lists(rows, near["plan_categories"], st["categories"], filters.lang)
    return _image(rows, near, "card", controlled, images).orderBy("rank"), envelope(found, filters)


def detailed(st: State, plan_id: int, now: datetime, controlled: str, lang: str = "ca", images: bool = True, retention_days: int = 0) -> DataFrame:
    """A plan as a reader gets it: with categories, sources and detail image; no row if it may not be seen."""
    row = settled(detail(st["plans"], plan_id, now, lang, retention_days))
    near = _around(row, st)
    row = category_lists(row, near["plan_categories"], st["categories"], lang)
    row = source_lists(row, near["plan_sources"], st["sources"])
    return _image(row, near, "detail", controlled, images)


def provinces(shown: DataFrame) -> DataFrame:
    return shown.where(F.trim("province") != "").select("province").distinct().orderBy(nocase(F.col("province")), "province")


def comarques(shown: DataFrame, province: str | None = None) -> DataFrame:
    """Comarques without regard to case; name and province are those of the row with the least province."""
    rows = shown.where(F.trim("comarca") != "")
    if province is not None:
        rows = rows.where(P.same_nocase("province", province))
    return rows.groupBy(nocase(F.col("comarca")).alias("k")).agg(F.min_by("comarca", F.struct("province", "comarca")).alias("comarca"), F.min("province").alias("province")).orderBy("k").drop("k")


def municipalities(shown: DataFrame, province: str | None = None, comarca: str | None = None) -> DataFrame:
    """Municipalities without regard to case; of several spellings the least."""
    rows = shown.where(F.trim("municipality") != "")
    for name, value in (("province", province), ("comarca", comarca)):
        if value is not None:
            rows = rows.where(P.same_nocase(name, value))
    return rows.groupBy(nocase(F.col("municipality")).alias("k")).agg(F.min("municipality").alias("municipality"), F.min("comarca").alias("comarca"), F.min("province").alias("province")).orderBy("k").drop("k")


def sitemap_ids(shown: DataFrame) -> DataFrame:
    return shown.where(F.col("kind") == "event").select("id").orderBy("id")


def sitemap_entries(shown: DataFrame, site: str, fixed=("/", "/plans", "/about")) -> DataFrame:
    """(position, line): one escaped <url> line for each fixed page and each public event."""
    spark = shown.sparkSession
    head = spark.createDataFrame([(i, site + p) for i, p in enumerate(fixed)], "position long, url string")
    events = shown.where(F.col("kind") == "event").select((F.col("id") + len(fixed)).alias("position"), F.concat(F.lit(f"{site}/plans/"), F.col("id").cast("string")).alias("url"))
    return head.union(events).select("position", F.concat(F.lit("<url><loc>"), xml_escape(F.col("url")), F.lit("</loc></url>")).alias("line"))


def home_upcoming(upcoming: DataFrame, weekend: DataFrame, most: int = 6) -> DataFrame:
    """The next plans that the weekend list doesn't show."""
    return upcoming.join(weekend.select("id"), "id", "left_anti").orderBy(F.col("start_date").asc_nulls_first(), "id").limit(most)
