"""What a reader sees of a plan: labels, structured data, maps and page metadata, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import first_nonempty, nonempty

# Month names of the two languages.
MONTHS = {
    "ca": ["gener", "febrer", "març", "abril", "maig", "juny", "juliol", "agost", "setembre", "octubre", "novembre", "desembre"],
    "es": ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"],
}
#: Degrees that a map shows on either side of a place.
MAP_LONGITUDE, MAP_LATITUDE = 0.009, 0.006


def date_label(permanent: str = "permanent") -> Column:
    """'permanent', one day, or a range; null without a start."""
    start, end = F.col("start_date"), F.col("end_date")
    several = end.isNotNull() & (end != "") & (end != start)
    return F.when(F.col("permanent") == 1, permanent).when(several, F.concat(start, F.lit(" – "), end)).otherwise(start)


def price_label(free: str = "free", unknown: str = "unknown") -> Column:
    return F.when(F.col("is_free") == 1, free).otherwise(F.coalesce(nonempty(F.col("price_text")), F.lit(unknown)))


def place_label(unknown: str = "unknown") -> Column:
    """Venue and municipality; without a venue municipality and comarca."""
    venue, town, region = (nonempty(F.col(n)) for n in ("venue_name", "municipality", "comarca"))
    return F.coalesce(nonempty(F.when(venue.isNotNull(), F.concat_ws(" · ", venue, town)).otherwise(F.concat_ws(" · ", town, region))), F.lit(unknown))


def location_label() -> Column:
    return F.concat_ws(" · ", *(nonempty(F.col(n)) for n in ("municipality", "comarca", "province")))


def primary_category() -> Column:
    """The first category's slug, else the kind."""
    return F.coalesce(F.try_element_at("categories", F.lit(1))["slug"], F.col("kind"))


def shown_image() -> Column:
    """The controlled image's URL, else the plan's own if its reuse is allowed."""
    return F.coalesce(F.col("image.url"), F.when(F.col("image_reuse_allowed"), F.col("image_url")))


def long_date(c: Column, lang: str) -> Column:
    """Day, month name and year of an ISO date."""
    names = F.array(*(F.lit(m) for m in MONTHS[lang]))
    of = F.lit(" de ")
    day = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")).cast("date"))
    return F.concat(F.dayofmonth(day).cast("string"), of, F.try_element_at(names, F.month(day)), of, F.year(day).cast("string"))


def map_box() -> Column:
    """Struct of west, south, east, north and the query of an embedded map; null without valid coordinates."""
    y, x = F.col("latitude"), F.col("longitude")
    good = y.between(-90, 90) & x.between(-180, 180)
    west, south, east, north = x - MAP_LONGITUDE, y - MAP_LATITUDE, x + MAP_LONGITUDE, y + MAP_LATITUDE
    box = F.concat_ws(",", *(e.cast("string") for e in (west, south, east, north)))
    query = F.concat(F.lit("bbox="), F.url_encode(box), F.lit("&marker="), F.url_encode(F.concat_ws(",", y.cast("string"), x.cast("string"))))
    return F.when(good, F.struct(west.alias("west"), south.alias("south"), east.alias("east"), north.alias("north"), query.alias("query")))


def json_ld(title: Column, url: Column, description: Column) -> Column:
    """A schema.org Event; null unless title, ISO start, a named place and its region are known."""
    c = F.col
    place = F.struct(
        F.lit("Place").alias("@type"),
        nonempty(c("venue_name")).alias("name"),
        F.struct(
            F.lit("PostalAddress").alias("@type"), nonempty(c("address")).alias("streetAddress"), nonempty(c("municipality")).alias("addressLocality"),
            nonempty(c("province")).alias("addressRegion"), nonempty(c("postal_code")).alias("postalCode"),
        ).alias("address"),
    )
    event = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("Event").alias("@type"), title.alias("name"), c("start_date").alias("startDate"),
        nonempty(c("end_date")).alias("endDate"), nonempty(description).alias("description"), url.alias("url"), place.alias("location"),
    )
    known = nonempty(title).isNotNull() & c("start_date").rlike(r"^\d{4}-\d{2}-\d{2}$") & nonempty(c("venue_name")).isNotNull() & first_nonempty(c("municipality"), c("comarca"), c("province")).isNotNull()
    return F.when(known, F.to_json(event))


def attribution_date() -> Column:
    return F.substring(F.coalesce("source_updated_at", "imported_at"), 1, 10)


def list_meta(filtered: bool, site: str, title: str) -> dict[str, str]:
    """Title, robots and canonical URL of the list's page; a filtered list is not indexed."""
    return {"title": title, "robots": "noindex,follow" if filtered else "index,follow", "canonical": f"{site}/plans"}


def page_meta(title: Column, site: str, suffix: str) -> Column:
    """Struct of title, robots and canonical URL of a plan's page; only events are indexed."""
    heading = F.concat_ws(" | ", F.concat_ws(" · ", title, nonempty(F.col("municipality"))), F.lit(suffix))
    robots = F.when(F.col("kind") == "event", "index,follow").otherwise("noindex,follow")
    return F.struct(heading.alias("title"), robots.alias("robots"), F.concat(F.lit(f"{site}/plans/"), F.col("id").cast("string")).alias("canonical"))
