"""Source records to canonical plans: projections, scores, fingerprints and identities."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_json, computed, coordinate, filled, fold, iso_prefix, key, location_tag, nonempty, safe_url, strip_html, title_key, without_keys, yes_no

# Categories of agenda records in order, each with the words in a tag that give it.
AGENDA_CATEGORIES = {
    "familia": ["familiar", "infantil", "nens", "nadons"],
    "musica": ["ambits/musica", "categories/concerts", "jazz", "opera"],
    "espectacles": ["ambits/espectacles", "arts-esceniques", "teatre", "dansa", "circ", "titelles", "magia"],
    "festes": ["tradicional-i-popular", "festes", "festa-major", "carnaval", "castellers", "gegants", "correfoc"],
    "fires-mercats": ["fires", "mercats", "fira-mercat"],
    "gastronomia": ["gastronomia", "gastronomic", "enologia"],
    "museus": ["museus", "museu"],
    "patrimoni": ["patrimoni", "monuments", "rutes-i-visites"],
    "cultura": ["arts-visuals", "cinema", "divulgacio", "llibres-i-lletres", "literatura", "exposicions", "conferencies"],
}
# The same for feed records, as patterns on the classification's text.
FEED_CATEGORIES = {
    "musica": "music|música|musica|concert",
    "espectacles": "arts|theatre|theater|dance|circus|comedy|espectáculo|espectacle",
    "cultura": "film|cinema|cultural",
    "familia": "family|children|infantil",
}
# Points of the two quality scores.
AGENDA_BASE, FEED_BASE = 5, 30


def _has(c: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(c != "", F.lit(False))


def _points(base: int, parts: list[tuple[Column, int]]) -> Column:
    total = F.lit(base)
    for present, points in parts:
        total = total + F.when(F.coalesce(present, F.lit(False)), points).otherwise(0)
    return F.least(total, F.lit(100)).cast("int")


def agenda_quality(n_categories: Column) -> Column:
    """Quality of a normalised agenda plan by what it has; at most 100."""
    c = F.col
    return _points(
        AGENDA_BASE,
        [
            (_has(c("original_title")), 15), (_has(c("original_description")), 15), (_has(c("start_date")) | (c("permanent") == 1), 10),
            (_has(c("municipality")), 10), (_has(c("comarca")), 5), (c("latitude").isNotNull() & c("longitude").isNotNull(), 10), (_has(c("address")), 5),
            (_has(c("website_url")), 10), (_has(c("price_text")) | c("is_free").isNotNull(), 5), (_has(c("schedule_text")), 5), (n_categories > 0, 5),
        ],
    )


def feed_quality(n_categories: Column, info: str = "original_description", url: str = "ticket_url") -> Column:
    """Quality of a feed plan; of text and link, what the record has counts, blank or faulty as it may be."""
    c = F.col
    return _points(
        FEED_BASE,
        [(_has(c(info)), 15), (_has(c("municipality")), 10), (c("latitude").isNotNull(), 10), (_has(c("address")), 5), (_has(c(url)), 10), (n_categories > 0, 5)],
    )


def agenda_fingerprint() -> Column:
    """Title key, municipality key, and the start date or a word for none."""
    tail = F.coalesce("start_date", F.when(F.col("permanent") == 1, "permanent").otherwise("sense-data"))
    return F.concat_ws("|", title_key(F.col("original_title")), key(F.col("municipality")), tail)


def feed_fingerprint(prefix: str = "feed") -> Column:
    c = F.col
    return F.concat_ws("|", F.lit(prefix), title_key(c("original_title")), key(c("municipality")), key(c("venue_name")), c("start_date"))


def _rules(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(hit, slug) for slug, hit in rules.items())))


def agenda_categories(*tags: Column) -> Column:
    """Slugs by words in the tags, which are folded once for all rules."""
    rules = lambda text: _rules({slug: text.rlike("|".join(map(re.escape, words))) for slug, words in AGENDA_CATEGORIES.items()})
    return computed(fold(F.concat_ws(" ", *tags)), rules)


def feed_categories(classes: Column) -> Column:
    """Slugs by patterns on a record's classification, all its fields in one text; its title says nothing."""
    return _rules({slug: F.coalesce(classes, F.lit("")).rlike(f"(?iu)(?:{pattern})") for slug, pattern in FEED_CATEGORIES.items()})


def payload_identity(code: Column, payload: Column) -> Column:
    """Code, '@' and 16 hex digits of the hash of the canonical payload."""
    return F.concat(code, F.lit("@"), F.substring(F.sha2(canonical_json(payload), 256), 1, 16))


RESTRICTED = ("imatges", "destacada_imatge", "imgapp")
# The same for feed records, at any depth.
FEED_RESTRICTED = ("eventImageUrl", "images", "image", "imageUrl")


def feed_payload(record: Column) -> Column:
    """A feed record (variant) as canonical JSON, whole but for image fields at any depth."""
    return without_keys(F.to_json(record), FEED_RESTRICTED)


def without_restricted_images(records: DataFrame) -> DataFrame:
    """Without image fields, and without img tags in the HTML description."""
    out = records.drop(*RESTRICTED)
    if "descripcio_html" in out.columns:
        out = out.withColumn("descripcio_html", F.regexp_replace("descripcio_html", r"(?i)<img\b[^>]*>", ""))
    return out


def agenda_plans(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Agenda records (all text) to plans with ``category_slugs``; records without code or title are left out.

    ``keep`` names further columns of the records to carry along.
    """
    c = F.col
    tag = F.coalesce(c("municipi"), c("comarca_i_municipi"))
    place, region = location_tag(tag), location_tag(c("comarca"))
    found = agenda_categories(c("tags_mbits"), c("tags_categor_es"), c("tags_altres_categor_es"))
    rows = records.where(_has(c("codi")) & filled(c("denominaci")).isNotNull()).withColumns({"_place": place, "_region": region, "_slugs": found})
    slugs = c("_slugs")
    null = F.lit(None).cast("string")
    rows = rows.select(
        *keep, c("codi").alias("code"), F.lit("event").alias("kind"), F.lit("ca").alias("original_language"), c("denominaci").alias("original_title"),
        filled(c("descripcio")).alias("original_description"), c("denominaci").alias("title_ca"), null.alias("title_es"), strip_html(c("subt_tol")).alias("subtitle_ca"),
        null.alias("subtitle_es"), filled(c("descripcio")).alias("description_ca"), null.alias("description_es"), iso_prefix(c("data_inici")).alias("start_date"),
        iso_prefix(c("data_fi")).alias("end_date"), strip_html(c("horari")).alias("schedule_text"), F.coalesce(yes_no(c("permanent")), F.lit(0)).alias("permanent"),
        strip_html(c("entrades")).alias("price_text"), yes_no(c("gratuita")).alias("is_free"),
        F.coalesce("_place.province", "_region.province").alias("province"), F.coalesce("_place.comarca", "_region.comarca").alias("comarca"),
        F.col("_place.municipality").alias("municipality"), filled(c("localitat")).alias("locality"), filled(c("adre_a")).alias("address"),
        filled(c("codi_postal")).alias("postal_code"), filled(c("espai")).alias("venue_name"), coordinate(c("latitud"), -90, 90).alias("latitude"),
        coordinate(c("longitud"), -180, 180).alias("longitude"), F.coalesce(safe_url(c("urlactivitat")), safe_url(c("enllac1_url")), safe_url(c("url"))).alias("website_url"),
        safe_url(c("linkbotoentrades")).alias("ticket_url"), null.alias("image_url"), F.lit(0).alias("image_reuse_allowed"),
        F.when(F.array_contains(slugs, "familia"), 1).alias("family_friendly"), F.lit(None).cast("int").alias("indoor"), F.lit(None).cast("int").alias("outdoor"),
        F.coalesce(yes_no(c("destacada")), F.lit(0)).alias("featured"), F.lit("active").alias("status"), slugs.alias("category_slugs"),
    )
    return rows.withColumns({"quality_score": agenda_quality(F.size("category_slugs")), "fingerprint": agenda_fingerprint()})


#: What a feed plan takes from the first record of its group.
FIRST = ("title", "info", "classes", "price", "province", "municipality", "address", "postal_code", "venue_name", "latitude", "longitude", "url", "event_status")


def feed_plans(feed: DataFrame, prefix: str = "feed") -> DataFrame:
    """Feed rows with ``group_id`` to plans, one for each group; the first record by ``pos`` gives what is not gathered.

    All columns of plans but id and stamps, with group_id, ``records`` (how many) and category_slugs.  Groups
    whose first title is blank make no plan.
    """
    c = F.col
    groups = feed.groupBy("group_id").agg(
        *(F.min_by(n, "pos").alias(n) for n in (*FIRST, "start_date")), F.max("end_date").alias("end_date"), F.array_sort(F.collect_set(nonempty(c("start_time")))).alias("hours"), F.count("*").alias("records"),
    ).where(filled(c("title")).isNotNull())
    slugs, text, whole = feed_categories(c("classes")), F.lit(None).cast("string"), F.lit(None).cast("int")
    town, info = filled(c("municipality")), filled(c("info"))
    rows = groups.select(
        "group_id", "records", F.lit("event").alias("kind"), text.alias("original_language"), c("title").alias("original_title"), info.alias("original_description"), c("title").alias("title_ca"), c("title").alias("title_es"),
        text.alias("subtitle_ca"), text.alias("subtitle_es"), info.alias("description_ca"), info.alias("description_es"), "start_date", "end_date", nonempty(F.array_join("hours", ", ")).alias("schedule_text"),
        F.lit(0).alias("permanent"), filled(c("price")).alias("price_text"), whole.alias("is_free"), "province", text.alias("comarca"), town.alias("municipality"), town.alias("locality"), filled(c("address")).alias("address"),
        nonempty(F.trim("postal_code")).alias("postal_code"), filled(c("venue_name")).alias("venue_name"), "latitude", "longitude", text.alias("website_url"), safe_url(c("url")).alias("ticket_url"), text.alias("image_url"),
        F.lit(0).alias("image_reuse_allowed"), slugs.alias("category_slugs"), F.when(F.array_contains(slugs, "familia"), 1).alias("family_friendly"), whole.alias("indoor"), whole.alias("outdoor"), text.alias("recommended_months"),
        F.lit(0).alias("featured"), F.when(c("event_status") == "cancelled", "cancelled").otherwise("active").alias("status"), "info", "url",
    )
    return rows.withColumns({"quality_score": feed_quality(F.size("category_slugs"), "info", "url"), "fingerprint": feed_fingerprint(prefix)}).drop("info", "url")
