"""Row predicates of the catalogue as columns, over the columns of ``plans``."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.text import fold, key, nocase, python_key

MIN_QUALITY = 35
FUTURE_YEARS = DURATION_YEARS = 10

# What marks a place as outside the territory, after folding.
_NOUNS = "(?:catalunya|cataluna|espanya|espana|estat espanyol|estado espanol)"
OUTSIDE = f"^(?:fora (?:de |d |del |de l )?{_NOUNS}|fuera (?:de |del )?{_NOUNS}|outside (?:of )?(?:catalonia|catalunya|spain))$"
LOCATION = ("province", "comarca", "municipality", "locality")


def effective_end() -> Column:
    return F.coalesce("end_date", "start_date")


def retained(cutoff: str) -> Column:
    """Permanent, undated, or not over before the cutoff."""
    return (F.col("permanent") == 1) | effective_end().isNull() | (effective_end() >= cutoff)


def expired(cutoff: str) -> Column:
    return (F.col("permanent") != 1) & effective_end().isNotNull() & (effective_end() < cutoff)


#: What a marked place can begin with, before it is folded; other texts, which are nearly all, need no folding.
_BEGINS = r"^[\x00-\x7f&&[^A-Za-z0-9]]*(?:[fFoO]|[^\x00-\x7f])"


def outside_territory(columns=LOCATION) -> Column:
    out = F.lit(False)
    for name in columns:
        marked = F.when(F.col(name).rlike(_BEGINS), key(F.col(name), " ").rlike(OUTSIDE))
        out = out | F.coalesce(marked, F.lit(False))
    return out


def _strict_date(c: Column) -> Column:
    """The date of a text in the form YYYY-MM-DD that the calendar has, else null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date"))


def _years_on(day: Column, years: int) -> Column:
    """The same day some years later; 29 February becomes 1 March where there is none."""
    leap = (F.month(day) == 2) & (F.dayofmonth(day) == 29)
    later = F.add_months(day, 12 * years)
    return F.when(leap & (F.dayofmonth(later) == 28), F.date_add(later, 1)).otherwise(later)


def coherence_issue(year: int) -> Column:
    """The first fault of an event's dates, null if there is none; other kinds and permanent plans have none."""
    start, end = F.col("start_date"), F.col("end_date")
    a, b = _strict_date(start), _strict_date(end)
    wrong = (start.isNotNull() & a.isNull()) | (end.isNotNull() & b.isNull())
    issue = (
        F.when(wrong, "INVALID_DATE_FORMAT")
        .when(b < a, "END_BEFORE_START")
        .when(F.greatest(F.year(a), F.year(b)) > year + FUTURE_YEARS, "EXTREME_FUTURE_DATE")
        .when(b > _years_on(a, DURATION_YEARS), "EVENT_DURATION_EXCEEDS_10_YEARS")
    )
    return F.when((F.col("kind") == "event") & ~F.coalesce(F.col("permanent") == 1, F.lit(False)), issue)


def visible(now: datetime, retention_days: int = 0, min_quality: int = MIN_QUALITY) -> Column:
    """What public queries may show."""
    return (
        (F.col("status") == "active")
        & (F.col("quality_score") >= min_quality)
        & retained(clock.retention_cutoff(now, retention_days))
        & ~outside_territory()
        & coherence_issue(clock.local_date(now).year).isNull()
    )


def text_search(q: str) -> Column:
    """The folded query stands in a title or the venue's name.  A query of punctuation alone matches all."""
    needle = F.lit(python_key(q))
    out = F.lit(False)
    for name in ("original_title", "title_ca", "title_es", "venue_name"):
        out = out | key(F.col(name)).contains(needle)
    return out


def same_key(name: str, value: str) -> Column:
    return key(F.col(name)) == python_key(value)


def same_nocase(name: str, value: str) -> Column:
    return nocase(F.col(name)) == value.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def during(first: str | None, last: str | None) -> Column:
    """Permanent, or overlapping the days from first to last; a missing bound is open."""
    dated = F.lit(True)
    if last is not None:
        dated = dated & (F.col("start_date") <= last)
    if first is not None:
        dated = dated & (F.col("end_date") >= first)
    return (F.col("permanent") == 1) | F.coalesce(dated, F.lit(False))


def starts_from(first: str) -> Column:
    return F.col("start_date").isNotNull() & (F.col("start_date") >= first)


def license_reason() -> Column:
    """Why a source may not be imported; null if it may.  The first reason counts."""
    flag = lambda n: F.coalesce(F.col(n) == 1, F.lit(False))
    blank = lambda n: F.coalesce(F.col(n) == "", F.lit(True))
    return (
        F.when(F.col("id").isNull(), "missing")
        .when(~flag("enabled"), "disabled")
        .when(~flag("allows_data_reuse"), "no reuse")
        .when(blank("license_name") | blank("license_url") | blank("reviewed_at"), "review incomplete")
        .when(flag("requires_attribution") & blank("attribution_text"), "attribution missing")
    )


def https_image() -> Column:
    """An image's URL is https and its sides are whole positive numbers up to 2048."""
    side = lambda n: F.col(n).isNotNull() & (F.col(n) > 0) & (F.col(n) <= 2048)
    return F.coalesce(F.lower(F.try_parse_url("url", F.lit("PROTOCOL"))) == "https", F.lit(False)) & side("width") & side("height")


def media_url(host: str) -> Column:
    """https, exactly this host, no credentials."""
    part = lambda n: F.try_parse_url("url", F.lit(n))
    return F.coalesce((F.lower(part("PROTOCOL")) == "https") & (F.lower(part("HOST")) == host) & part("USERINFO").isNull(), F.lit(False))


def place_text() -> Column:
    """Municipality, comarca and province, joined and folded."""
    return F.trim(fold(F.concat_ws(" ", "municipality", "comarca", "province")))


def place_query(query: str, aliases: dict[str, str] | None = None) -> str:
    """A folded query for ``place_text``; aliases rename a whole query."""
    wanted = python_key(query).replace("-", " ")
    return (aliases or {}).get(wanted, wanted)


def combobox(query: str, aliases: dict[str, str] | None = None) -> Column:
    """The folded query stands in municipality, comarca and province, joined."""
    return place_text().contains(place_query(query, aliases))
