"""Import of a complete feed: funnel, groups, matches with another source, upsert by group, reconciliation.

Every counter is observed where a result is computed that the import needs anyway.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.session import observed, settled
from . import feed as feeds
from . import normalize, state

State = dict[str, DataFrame]

#: The counters of an import, in their order.
COUNTERS = (
    "records", "accepted", "accepted_trium", "accepted_mfx_es", "excluded_universe", "excluded_mfx_external", "excluded_other", "within_horizon", "candidates", "outside", "out_of_horizon",
    "recurring", "variants", "denied", "invalid", "new_plans", "updates", "unchanged", "confirmed_merges", "possible_merges", "removals",
)


def _true(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def prepared(feed: DataFrame, policy: feeds.Policy, first: str, last: str) -> tuple[State, dict[str, int]]:
    """The frames that lead to a feed's plans, and the counters of what falls out on the way.

    rows (all, with ``reason``), inventory, variants, kept (with group_id) and plans.  Of an event_id that the
    feed has twice, the first record counts.  Denied ids leave after inventory and variants are found: they count in a
    group and can be a main event.
    """
    reason, seen, bucket = F.col("reason"), F.col("seen"), F.col("bucket")
    inside = seen & (reason.isNull() | reason.isin("territory", "denied"))
    rows, n = observed(
        feeds.funnel(feed, first, last, policy), records=F.count("*"), accepted=_true(seen), accepted_trium=_true(seen & (F.col("source") == "trium")), accepted_mfx_es=_true(seen & (F.col("source") == "mfx-es")),
        excluded_universe=_true(bucket == "universe"), excluded_mfx_external=_true(bucket == "mfx-external"), excluded_other=_true(bucket == "other"), within_horizon=_true(inside),
        candidates=_true(inside & (reason.isNull() | (reason == "denied"))), outside=_true(seen & (reason == "territory")), out_of_horizon=_true(reason == "dates:out"), invalid=_true(reason.isin("dates:invalid", "unnamed")),
    )
    candidates = rows.where("reason IS NULL OR reason = 'denied'").withColumn("province", F.col("place.province")).drop("place", "bucket", "seen")
    inventory = settled(feeds.recurring_inventory(candidates, policy.recurring))
    rest, left = observed(feeds.without_recurring(candidates, inventory), left=F.count("*"), denied=_true(reason == "denied"))
    variants, found = observed(feeds.product_variants(rest).join(rest.where("reason IS NULL").select("event_id"), "event_id", "left_semi"), variants=F.count("*"))
    main = rest.where("reason IS NULL").join(variants.select("event_id"), "event_id", "left_anti")
    once = main.join(main.groupBy("event_id").agg(F.min("pos").alias("pos")), ["event_id", "pos"], "left_semi")
    kept = settled(feeds.with_groups(once))
    plans, made = observed(normalize.feed_plans(kept), planned=F.sum("records"))
    n |= {"recurring": n["candidates"] - left["left"], "denied": left["denied"], "variants": found["variants"]}
    n["invalid"] += kept.count() - made["planned"]
    return {"rows": rows, "inventory": inventory, "variants": variants, "kept": kept, "plans": plans}, n


def matched(plans: DataFrame, st: State, other: str) -> tuple[DataFrame, DataFrame]:
    """``cross_source_matches`` of the feed's plans by group_id, and the plans of the other source."""
    foreign = st["plan_sources"].join(st["sources"].where(F.col("key") == other).select(F.col("id").alias("source_id")), "source_id", "left_semi")
    others = settled(st["plans"].join(foreign.select(F.col("plan_id").alias("id")), "id", "left_semi"))
    return settled(feeds.cross_source_matches(plans.withColumn("id", F.col("group_id")), others)), others


def import_feed(
    feed: DataFrame, st: State, now: datetime, policy: feeds.Policy, source_id: int, days: int = 90, other: str = "agenda", dry_run: bool = False
) -> tuple[State, dict[str, int], State]:
    """The state after the import (as it was, for a dry run), the counters, and the details.

    A group's first record decides: a known one with another payload overwrites its plan, unless another source's plan is
    surely the same, which is only filled; the group's other records fill.  A dry run counts a group as update if any of
    its records is known.  What the feed no longer has inside the horizon loses its link; ids that were seen but
    dropped keep theirs.  Details: recurring, variants, possible_merges (original_title, candidate) and removals.
    """
    first, last = clock.horizon(now, days)
    parts, n = prepared(feed, policy, first, last)
    kept, plans = parts["kept"], parts["plans"]
    matches, others = matched(plans, st, other)
    confirmed = matches.select(F.col("id").alias("group_id"), F.col("confirmed").alias("target_id"), "n_possible")
    known = st["plan_sources"].where(F.col("source_id") == source_id)
    links, stamp = st["plan_sources"], clock.inactive_cutoff(now, 0)
    record = kept.select("group_id", "pos", F.col("event_id").cast("string").alias("record_id"), F.col("url").alias("source_url"), normalize.feed_payload(F.col("record")).alias("payload"))
    merges = {"confirmed_merges": _true(F.col("target_id").isNotNull()), "possible_merges": _true(F.col("n_possible") > 0)}
    if dry_run:
        held = record.join(known.select(F.col("source_record_id").alias("record_id")), "record_id", "left_semi").select("group_id", F.lit(True).alias("held")).distinct()
        groups = plans.select("group_id").join(confirmed, "group_id", "left").join(held, "group_id", "left")
        new = F.col("held").isNull() & F.col("target_id").isNull()
        _, counted = observed(groups, updates=_true(F.col("held")), new_plans=_true(new), unchanged=F.count_if(F.lit(False)), **merges)
        after = st
    else:
        incoming = settled(record.join(plans.drop("records"), "group_id").join(confirmed, "group_id", "left"))
        leads = lambda o: _true(F.col("leads") & (F.col("outcome") == o))
        lead = {name: _true(F.col("leads") & c) for name, c in (("confirmed_merges", F.col("target_id").isNotNull()), ("possible_merges", F.col("n_possible") > 0))}
        outcomes, counted = observed(state.upsert_outcomes(incoming, st["plan_sources"], st["plans"], source_id), new_plans=leads("inserted"), updates=leads("updated"), unchanged=leads("skipped"), **lead)
        after = state.apply_batch(st, outcomes, source_id, stamp)
        after |= {name: settled(after[name]) for name in ("plans", "plan_sources")}
        links = after["plan_sources"]
    candidates = state.reconciliation_candidates(links, after["plans"], source_id, first, last)
    lost, gone = observed(state.missing_links(candidates, parts["rows"].where("seen").select("event_id")).select("id", "plan_id", "source_record_id"), removals=F.count("*"))
    if not dry_run:
        after = state.remove_links(after, lost, stamp)
    possible = feeds.possible_matches(matches, plans.withColumn("id", F.col("group_id")), others)
    titled = possible.join(plans.select(F.col("group_id").alias("id"), "original_title"), "id").select("original_title", "candidate")
    details = {"recurring": parts["inventory"], "variants": parts["variants"], "possible_merges": titled, "removals": lost.select("source_record_id", "plan_id")}
    every = n | counted | gone
    return after, {c: every[c] for c in COUNTERS}, details


def run_counters(n: dict[str, int]) -> dict[str, int]:
    """An import's counters as the ledger has them."""
    left_out = ("outside", "out_of_horizon", "recurring", "variants", "denied", "invalid", "unchanged")
    return {"fetched": n["records"], "inserted": n["new_plans"], "updated": n["updates"] + n["confirmed_merges"], "skipped": sum(n[c] for c in left_out), "invalid": n["invalid"], "errors": 0}
