"""Feed funnel: source policy, dates, territory, inventory, variants, sessions and matching.

Rows carry ``pos``, their place of arrival, wherever the first of several counts.  Feed rows have
event_id, title, venue_id, venue_name, municipality, start_date, end_date, start_time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import settled
from ..functions.text import computed, key, nocase, nonempty, title_key
from .ordering import ranked_within

# Provinces of the territory, their folded names and postal prefixes, and its bounds.
PROVINCES = {"barcelona": "Barcelona", "girona": "Girona", "gerona": "Girona", "lleida": "Lleida", "lerida": "Lleida", "tarragona": "Tarragona"}
PREFIXES = {"08": "Barcelona", "17": "Girona", "25": "Lleida", "43": "Tarragona"}
LATITUDES, LONGITUDES = (40.45, 42.95), (0.0, 3.45)
# Marks of package and add-on products in a title.
PACKAGE = r"(?iU)\s*\|\s*paquetes?\s+vip\s*$"
ADD_ON = r"(?i)^\s*(?:upgrade(?![A-Za-z0-9_])|meet\s*&\s*greet(?![A-Za-z0-9_]))"
ADD_ON_WORDS = r"(?i)(?<![A-Za-z0-9_])(?:upgrade|meet\s*&\s*greet)(?![A-Za-z0-9_])"


@dataclass(frozen=True)
class Recurring:
    """Thresholds of extreme recurring inventory; all must hold."""

    sessions: int = 80
    active_days: int = 21
    span_days: int = 28
    per_day: float = 4
    multi_share: float = 0.75
    active_share: float = 0.60


@dataclass(frozen=True)
class Policy:
    """Which feed records count: those of an official seller, of this brand and of these sources; ids that never do; what is recurring inventory."""

    brand: str
    accepted: tuple[str, ...] = ("trium", "mfx-es")
    denied: tuple[str, ...] = ()
    recurring: Recurring = Recurring()


def source_bucket(policy: Policy) -> Column:
    """accepted, universe, mfx-external or other, of source, brand_name and official_seller."""
    good = F.col("source").isin(*policy.accepted) & (F.col("official_seller") == True) & (F.col("brand_name") == policy.brand)  # noqa: E712
    return F.when(F.coalesce(good, F.lit(False)), "accepted").when(F.col("source") == "universe", "universe").when(F.col("source") == "mfx-external", "mfx-external").otherwise("other")


def dated(c: Column) -> Column:
    """A text in the form of a date, else null; the calendar isn't asked."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c)


def horizon_class(first: str, last: str) -> Column:
    """invalid, out or accepted: of rows that are not over before ``first`` and start by ``last``; an end that is no date counts as none."""
    start = dated(F.col("start_date"))
    end = F.coalesce(dated(F.col("end_date")), start)
    return F.when(start.isNull() | (end < start), "invalid").when((end >= first) & (start <= last), "accepted").otherwise("out")


def _number(c: Column) -> Column:
    """As a number; null and blank count as 0, what is no number is null."""
    value = F.trim(c).try_cast("double")
    return F.when(c.isNull() | (F.trim(c) == ""), 0.0).otherwise(F.when(~F.isnan(value), value))


def territory(country: Column, province: Column, postal: Column, latitude: Column, longitude: Column) -> Column:
    """Struct of confirmed, province, latitude and longitude.

    Coordinates outside the bounds contradict; missing ones count as 0, 0; if one is no number, both are null and neither contradicts.
    """
    known = F.create_map(*[F.lit(x) for kv in PROVINCES.items() for x in kv])
    prefixes = F.create_map(*[F.lit(x) for kv in PREFIXES.items() for x in kv])
    named, posted = F.try_element_at(known, key(province)), F.try_element_at(prefixes, F.substring(F.trim(postal), 1, 2))
    parts = F.struct(F.coalesce(named, posted).alias("province"), _number(latitude.cast("string")).alias("y"), _number(longitude.cast("string")).alias("x"))
    return computed(parts, lambda p: _confirmed(F.coalesce(F.upper(country) == "ES", F.lit(False)), p["province"], p["y"], p["x"]))


def _confirmed(home: Column, place: Column, y: Column, x: Column) -> Column:
    both = y.isNotNull() & x.isNotNull()
    contradicted = F.coalesce(~(y.between(*LATITUDES) & x.between(*LONGITUDES)), F.lit(False)) & both
    return F.struct((home & place.isNotNull() & ~contradicted).alias("confirmed"), place.alias("province"), F.when(both, y).alias("latitude"), F.when(both, x).alias("longitude"))


def keyed(feed: DataFrame) -> DataFrame:
    """With the keys that grouping and matching use: title_k, venue_k, place_k."""
    return feed.withColumns({"title_k": title_key(F.col("title")), "venue_k": F.coalesce(nonempty(F.col("venue_id")), key(F.col("venue_name"))), "place_k": key(F.col("municipality"))})


def recurring_inventory(feed: DataFrame, policy: Recurring = Recurring()) -> DataFrame:
    """One row for each group of title, venue and place that is extreme recurring inventory."""
    groups = ["title_k", "venue_k", "place_k"]
    days = keyed(feed).groupBy(*groups, "start_date").agg(F.count("*").alias("n"), F.min(F.struct("pos", "title", "venue_name")).alias("one"))
    found = days.groupBy(*groups).agg(
        F.sum("n").alias("sessions"), F.count("*").alias("active_days"), F.min("start_date").alias("first_date"), F.max("start_date").alias("last_date"),
        F.count_if(F.col("n") > 1).alias("multi"), F.min("one").alias("one"),
    ).withColumn("span_days", F.datediff("last_date", "first_date") + 1)
    p, c = policy, F.col
    found = found.where(
        (c("sessions") >= p.sessions) & (c("active_days") >= p.active_days) & (c("span_days") >= p.span_days) & (c("sessions") / c("active_days") >= p.per_day)
        & (c("multi") / c("active_days") >= p.multi_share) & (c("active_days") / c("span_days") >= p.active_share)
    )
    return found.select(*groups, "one.title", "one.venue_name", "sessions", "active_days", "span_days", "first_date", "last_date")


def without_recurring(feed: DataFrame, found: DataFrame) -> DataFrame:
    return keyed(feed).join(found.select("title_k", "venue_k", "place_k"), ["title_k", "venue_k", "place_k"], "left_anti").drop("title_k", "venue_k", "place_k")


def with_groups(feed: DataFrame) -> DataFrame:
    """Rows with ``group_id``, the first ``pos`` among those of the same title, venue, place and day."""
    rows, by = keyed(feed), ["title_k", "venue_k", "place_k", "start_date"]
    return rows.join(rows.groupBy(*by).agg(F.min("pos").alias("group_id")), by).drop("title_k", "venue_k", "place_k")


def daily_sessions(feed: DataFrame) -> DataFrame:
    """One row for each title, venue, place and day: the first record's place, latest end and the distinct start times."""
    return keyed(feed).groupBy("title_k", "venue_k", "place_k", "start_date").agg(
        F.max("end_date").alias("end_date"),
        F.array_sort(F.collect_set(nonempty(F.col("start_time")))).alias("hours"),
        F.min("pos").alias("first_pos"),
        F.min_by("venue_name", "pos").alias("venue_name"),
        F.count("*").alias("records"),
    )


def product_variants(feed: DataFrame) -> DataFrame:
    """(event_id, type, main_event_id): package and add-on products with the first main event that they match.

    Only rows whose title bears a mark look for main events.  Of the main events of one title, place and day (and
    hour, for packages) the first two count, as one of them may be the product itself; the titles that are
    like an add-on's are found once for each title of an add-on, so no product meets all events of its place.
    """
    rows = keyed(feed).where(F.col("venue_k") != "")
    rows = rows.withColumns({n: F.coalesce(F.concat(F.lit("="), c), F.lit("")) for n, c in (("day", "start_date"), ("hour", "start_time"))}).select("event_id", "pos", "title", "title_k", *SPOT, "hour")
    rows = settled(rows)
    packages = rows.where(F.col("title").rlike(PACKAGE)).withColumn("base", title_key(F.regexp_replace("title", PACKAGE, "")))
    timed = _first_two(rows, [*SPOT, "hour", "title_k"]).withColumnRenamed("title_k", "base")
    packages = packages.join(timed, [*SPOT, "hour", "base"]).withColumn("type", F.lit("PACKAGE_VARIANT"))
    extras = rows.where(F.col("title").rlike(ADD_ON)).withColumn("base", title_key(F.regexp_replace("title", ADD_ON_WORDS, " "))).where("base != ''")
    like = _shared_out(extras.select(*SPOT, "base").distinct(), _first_two(rows, [*SPOT, "title_k"]), SPOT).where(F.col("base").contains(F.col("title_k")) | F.col("title_k").contains(F.col("base")))
    like = _first_two(like.select(*SPOT, "base", F.col("main.pos").alias("pos"), F.col("main.event_id").alias("event_id")), [*SPOT, "base"])
    extras = extras.join(like, [*SPOT, "base"]).withColumn("type", F.lit("PRODUCT_VARIANT"))
    both = packages.select("event_id", "pos", "type", "main").union(extras.select("event_id", "pos", "type", "main")).where(F.col("pos") != F.col("main.pos"))
    return both.groupBy("event_id", "pos").agg(F.min(F.struct("type", "main")).alias("x")).select("event_id", "x.type", F.col("x.main.event_id").alias("main_event_id"))


#: Where and when a product and its main event are.
SPOT = ["venue_k", "place_k", "day"]


def _first_two(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and ``main`` (pos, event_id): of each group the rows of the two least ``pos``."""
    place = F.dense_rank().over(Window.partitionBy(*by).orderBy("pos"))
    return rows.where("pos IS NOT NULL").select(*by, "pos", "event_id").withColumn("n", place).where("n <= 2").select(*by, F.struct("pos", "event_id").alias("main"))


def near(tolerance: float = 0.002) -> Column:
    close = lambda n: F.abs(F.col(n) - F.col(f"c_{n}")) <= tolerance
    return F.coalesce(close("latitude") & close("longitude"), F.lit(False))


#: Points of one cell that one task compares with candidates; a fuller cell has several shares.
SHARE = 2_000
#: What candidates have in common with an incoming plan: 128 bits of the digest of its day, town and title.
SAME = ["same"]


def _placed(plans: DataFrame) -> DataFrame:
    """id, SAME and the signs by which a plan is known again: venue, place and coordinates.

    A title can be as long as a text, and rows move many times with what they have in common, so its digest moves.
    """
    c = F.col
    # The day's length and the key's lack of line ends keep the three apart.
    whole = F.concat(F.length("start_date").cast("string"), F.lit(" "), "start_date", title_key(c("original_title")), F.lit("\n"), nocase(c("municipality")))
    keys = {"same": F.unhex(F.left(F.sha2(whole, 256), F.lit(32))), "venue": key(c("venue_name")), "place": key(c("address"))}
    return plans.where(c("start_date").isNotNull() & (c("municipality") != "")).withColumns(keys).select("id", *SAME, "venue", "place", "latitude", "longitude")


def _shared_out(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """``left`` joined with ``right`` (other columns than ``on`` differ); keys with more than SHARE left rows are dealt into shares, each with all of the key's right rows."""
    hot = left.groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") > SHARE).select(*on, F.ceil(F.col("n") / SHARE).cast("int").alias("shares"))
    hot = settled(hot)
    own = [c for c in left.columns if c not in on]
    one = left.join(hot, on, "left").withColumn("share", F.coalesce(F.pmod(F.xxhash64(*own), F.col("shares")).cast("int"), F.lit(0))).drop("shares")
    all_ = right.join(hot, on, "left").withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("shares") - 1, F.lit(0))))).drop("shares")
    return one.join(all_, [*on, "share"]).drop("share")


def _nearest(left: DataFrame, right: DataFrame, tolerance: float) -> DataFrame:
    """(id, sure): the smallest candidate within the tolerance.

    Equal points count once on either side; a candidate is in all cells that a little more than the tolerance
    around it touches, two each way at most but for rounding, and the exact distance decides.
    """
    reach = tolerance * 1.01
    cell = lambda c: F.floor(c / (2 * reach))
    cells = lambda n: F.sequence(cell(F.col(n) - reach), cell(F.col(n) + reach))
    here, there = left.select(*SAME, "latitude", "longitude").where("latitude IS NOT NULL AND longitude IS NOT NULL").distinct(), right.where("latitude IS NOT NULL AND longitude IS NOT NULL")
    here = here.withColumns({"y": cell(F.col("latitude")), "x": cell(F.col("longitude"))})
    there = there.groupBy(*SAME, F.col("latitude").alias("c_latitude"), F.col("longitude").alias("c_longitude")).agg(F.min("id").alias("c_id"))
    there = there.withColumn("y", F.explode(cells("c_latitude"))).withColumn("x", F.explode(cells("c_longitude")))
    found = _shared_out(here, there, [*SAME, "y", "x"]).where(near(tolerance)).groupBy(*SAME, "latitude", "longitude").agg(F.min("c_id").alias("sure"))
    return left.join(found, [*SAME, "latitude", "longitude"]).select("id", "sure")


def cross_source_matches(incoming: DataFrame, plans: DataFrame, tolerance: float = 0.002) -> DataFrame:
    """For each incoming plan with candidates: confirmed, the first plan that is surely the same, and n_possible, how many candidates come before it.

    ``plans`` are those of the other source, by id.  Candidates have the same day, municipality
    (ASCII case aside) and title key; venue, address or nearness confirms one.  Without a confirmed one
    all candidates are possible; ``possible_matches`` lists them.

    Each sign is an equality of its own and gives a minimum, so plans are never compared pair by pair
    unless they are in neighbouring cells of the grid; a crowded cell is dealt into shares.
    """
    left, right = settled(_placed(incoming)), settled(_placed(plans))
    sure = _nearest(left, right, tolerance)
    for sign in ("venue", "place"):
        first = right.where(F.col(sign) != "").groupBy(*SAME, sign).agg(F.min("id").alias("sure"))
        sure = sure.union(left.join(first, [*SAME, sign]).select("id", "sure"))
    confirmed = sure.groupBy("id").agg(F.min("sure").alias("confirmed"))
    totals = right.groupBy(*SAME).agg(F.count("*").alias("n"))
    places = ranked_within(right.select(F.col("id").alias("confirmed"), *SAME), SAME, "confirmed", "earlier").select("confirmed", "earlier")
    rows = left.select("id", *SAME).join(totals, SAME).join(confirmed, "id", "left").join(places, "confirmed", "left")
    return rows.select("id", "confirmed", F.coalesce("earlier", "n").cast("long").alias("n_possible"))


def possible_matches(matches: DataFrame, incoming: DataFrame, plans: DataFrame) -> DataFrame:
    """(id, candidate): the candidates that ``cross_source_matches`` counts, as rows; as many as it counts."""
    left = _placed(incoming).join(matches.where("n_possible > 0").select("id", "confirmed"), "id").select("id", "confirmed", *SAME)
    pairs = _shared_out(settled(left), _placed(plans).select(F.col("id").alias("candidate"), *SAME), SAME)
    return pairs.where("confirmed IS NULL OR candidate < confirmed").select("id", "candidate")


def funnel(feed: DataFrame, first: str, last: str, policy: Policy) -> DataFrame:
    """Each row with the first ``reason`` that drops it, null if none does; ``seen`` marks rows of an accepted source.

    Order: source, dates, names (an id and a title), horizon, territory, denied ids.  Recurring inventory and
    variants are found among what is left.  An end that is no date becomes the start.
    """
    bucket, horizon, unnamed = F.col("bucket"), F.col("_horizon"), (F.coalesce(F.col("event_id").cast("string"), F.lit("")) == "") | (F.coalesce("title", F.lit("")) == "")
    reason = (
        F.when(bucket != "accepted", F.concat(F.lit("source:"), bucket))
        .when(horizon == "invalid", "dates:invalid")
        .when(unnamed, "unnamed")
        .when(horizon == "out", "dates:out")
        .when(~F.col("place.confirmed"), "territory")
        .when(F.col("event_id").cast("string").isin(list(policy.denied)), "denied")
    )
    # What several columns are made of is computed once; all in one expression is more code than the JVM compiles.
    placed = feed.withColumns({"place": territory(F.col("country"), F.col("state"), F.col("postal_code"), F.col("latitude"), F.col("longitude")), "bucket": source_bucket(policy), "_horizon": horizon_class(first, last)})
    rows = placed.withColumns({"reason": reason, "seen": bucket == "accepted"}).drop("_horizon")
    return rows.withColumns({"end_date": F.coalesce(dated(F.col("end_date")), "start_date"), "latitude": F.col("place.latitude"), "longitude": F.col("place.longitude")})


def funnel_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
