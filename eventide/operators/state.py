"""Catalogue state: batch upsert, provenance, reconciliation, retention, removal, images and the run ledger.

State is a dict of DataFrames.  Operators return new frames; ``sources.snapshot`` writes them to a
new folder and swaps it in last, so a failed run changes nothing.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.session import settled
from . import predicates as P
from .ordering import carried, numbered, running_sum

#: Columns that a fill never takes over from a later record.
NEVER_FILLED = ("id", "fingerprint", "quality_score", "status", "inactive_at", "created_at", "updated_at")


def upsert_outcomes(incoming: DataFrame, provenance: DataFrame, plans: DataFrame, source_id: int, top: int | None = None) -> DataFrame:
    """``incoming`` (pos, record_id, fingerprint, payload, optionally target_id and group_id) with plan_id, outcome and action.

    skipped: known with equal payload; updated: known with another payload, or new but attached to
    a plan: to ``target_id``, to one with this fingerprint of the catalogue, or of an earlier record of the
    batch; inserted: the rest.  New plans get the ids after the largest (or after ``top``, where ``plans`` are but some of
    all), in order of arrival.  Of a record_id that comes twice, later rows meet what the earlier left.

    Records with one ``group_id``, the pos of the first of them, describe one plan; their record_ids are distinct.
    The first decides as above; a later one that is not known goes to the plan of the one before it.

    action: insert, overwrite (known, and neither later in its group nor with a target), fill or touch (skipped).
    """
    known = provenance.where(F.col("source_id") == source_id).select(F.col("source_record_id").alias("record_id"), F.col("plan_id").alias("known_plan"), F.col("source_payload_json").alias("old_payload"))
    prints = plans.groupBy("fingerprint").agg(F.min("id").alias("print_plan"))
    #: The join by record comes last, as the windows go on from its partitions.
    rows = incoming.join(prints, "fingerprint", "left").join(known, "record_id", "left")
    if "target_id" not in incoming.columns:
        rows = rows.withColumn("target_id", F.lit(None).cast("long"))
    grouped = "group_id" in incoming.columns
    by_record = Window.partitionBy("record_id").orderBy("pos")
    turn, previous = (F.lit(1), F.lit(None).cast("string")) if grouped else (F.row_number().over(by_record), F.lag("payload").over(by_record))
    rows = rows.withColumns({"turn": turn, "previous": previous, "leads": F.col("pos") == F.col("group_id") if grouped else F.lit(True)})
    rows = rows.withColumn("attached", F.coalesce("known_plan", F.when(F.col("leads"), F.coalesce("target_id", "print_plan"))))
    rows = settled(rows)
    fresh = rows.where("attached IS NULL AND leads AND turn = 1").groupBy("fingerprint").agg(F.min("pos").alias("pos"))
    ids = numbered(fresh, plans if top is None else top, "pos").select("fingerprint", F.col("id").alias("new_plan"), F.col("pos").alias("opened"))
    rows = rows.join(ids, "fingerprint", "left").withColumn("opens", F.col("attached").isNull() & F.coalesce(F.col("pos") == F.col("opened"), F.lit(False)))
    rows = rows.withColumn("plan_id", F.coalesce("attached", F.when(F.col("leads"), F.col("new_plan"))))
    if grouped:
        rows = carried(rows, "group_id", "pos", "plan_id")
    else:
        rows = rows.withColumn("plan_id", F.when(F.col("turn") > 1, F.first("plan_id").over(by_record)).otherwise(F.col("plan_id")))
    there = F.col("known_plan").isNotNull() | (F.col("turn") > 1)
    same = F.when(F.col("turn") > 1, F.col("payload").eqNullSafe(F.col("previous"))).otherwise(F.col("known_plan").isNotNull() & F.col("payload").eqNullSafe(F.col("old_payload")))
    outcome = F.when(same, "skipped").when(F.col("opens"), "inserted").otherwise("updated")
    action = F.when(same, "touch").when(F.col("opens"), "insert").when(there & F.col("leads") & F.col("target_id").isNull(), "overwrite").otherwise("fill")
    return rows.withColumns({"outcome": outcome, "action": action}).drop("turn", "previous", "opens", "opened", "known_plan", "old_payload", "print_plan", "attached", "new_plan")


def fold_fills(rows: DataFrame, group: str, by: str, columns: list[str]) -> DataFrame:
    """One row for each group: of each column the first value that is not null, in order of arrival; the best quality."""
    first = {c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(by))).alias(c) for c in columns if c not in NEVER_FILLED}
    over = [F.min_by("status", F.when(F.col("action") == "overwrite", F.col(by))).alias("over_status")] if "action" in rows.columns else []
    return rows.groupBy(group).agg(*first.values(), F.max("quality_score").alias("quality_score"), F.max(F.col("status") == "active").alias("any_active"), *over)


def fold_updates(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``fold_fills`` of overwrites and fills by plan (id): what comes before a plan's last overwrite is lost, later fills go on from there."""
    last = rows.where("action = 'overwrite'").groupBy("id").agg(F.max("pos").alias("_from"))
    return fold_fills(rows.join(last, "id", "left").where("_from IS NULL OR pos >= _from").drop("_from"), "id", "pos", columns)


def fill(plans: DataFrame, folded: DataFrame, now: str) -> DataFrame:
    """Plans with nulls filled from ``folded`` (by id); an inactive plan with an active record becomes active.

    Where ``folded`` has an ``over_status``, all its columns replace the plan's.
    """
    new = folded.select(F.col("id"), *(F.col(c).alias(f"_{c}") for c in folded.columns if c != "id"))
    joined = plans.join(new, "id", "left")
    hit = F.col("_quality_score").isNotNull() | F.col("_any_active").isNotNull()
    over = F.col("_over_status").isNotNull() if "over_status" in folded.columns else F.lit(False)
    status = F.coalesce("_over_status", "status") if "over_status" in folded.columns else F.col("status")
    active = F.coalesce("_any_active", F.lit(False))
    out = {c: F.when(over, F.col(f"_{c}")).otherwise(F.coalesce(c, f"_{c}")) for c in plans.columns if f"_{c}" in new.columns and c not in NEVER_FILLED}
    out |= {
        "quality_score": F.when(over, F.col("_quality_score")).otherwise(F.greatest("quality_score", "_quality_score")),
        "status": F.when(active & (status == "inactive"), "active").otherwise(status),
        "inactive_at": F.when(active, None).otherwise(F.col("inactive_at")),
        "updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at")),
    }
    return joined.withColumns(out).select(*plans.columns)


def overwrite(plans: DataFrame, incoming: DataFrame, now: str) -> DataFrame:
    """Plans with every column of ``incoming`` (by id) but the fingerprint; an active one loses its inactive time."""
    taken = [c for c in incoming.columns if c in plans.columns and c not in ("id", "fingerprint", "created_at", "updated_at", "inactive_at")]
    new = incoming.select("id", F.lit(True).alias("_hit"), *(F.col(c).alias(f"_{c}") for c in taken))
    hit = F.coalesce("_hit", F.lit(False))
    out = {c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in taken}
    out["updated_at"] = F.when(hit, F.lit(now)).otherwise(F.col("updated_at"))
    if "status" in taken:
        out["inactive_at"] = F.when(hit & (F.col("_status") == "active"), None).otherwise(F.col("inactive_at"))
    return plans.join(new, "id", "left").withColumns(out).select(*plans.columns)


def reactivate(plans: DataFrame, seen: DataFrame, now: str) -> DataFrame:
    """Inactive plans among ``seen`` (id) become active; cancelled ones stay."""
    hit = plans.join(seen.select("id", F.lit(True).alias("_seen")).distinct(), "id", "left")
    back = F.coalesce("_seen", F.lit(False)) & (F.col("status") == "inactive")
    return hit.withColumns(
        {"inactive_at": F.when(back, None).otherwise(F.col("inactive_at")), "updated_at": F.when(back, F.lit(now)).otherwise(F.col("updated_at")), "status": F.when(back, "active").otherwise(F.col("status"))}
    ).select(*plans.columns)


def apply_batch(state: dict[str, DataFrame], rows: DataFrame, source_id: int, now: str, top_link: int | None = None) -> dict[str, DataFrame]:
    """State after a batch: ``rows`` are those of ``upsert_outcomes`` with the columns of plans and ``category_slugs``.

    New plans come first; then each plan takes its overwrites and fills in order of arrival; plans of skipped active records become active.
    ``top_link`` is the largest id of a link, where the state has but some of them.
    """
    plans = state["plans"]
    taken = [c for c in plans.columns if c in rows.columns and c != "id"]
    new = rows.where("action = 'insert'").select(F.col("plan_id").alias("id"), *taken)
    stamps = {"created_at": F.lit(now), "updated_at": F.lit(now)}
    absent = {c: F.lit(None).cast(plans.schema[c].dataType) for c in plans.columns if c not in new.columns}
    plans = plans.unionByName(new.withColumns(absent | stamps).select(*(F.col(c).cast(plans.schema[c].dataType) for c in plans.columns)))
    changed = rows.where("action IN ('overwrite', 'fill')").drop("id").withColumn("id", F.col("plan_id"))
    plans = fill(plans, fold_updates(changed, taken), now)
    plans = reactivate(plans, rows.where((F.col("action") == "touch") & (F.col("status") == "active")).select(F.col("plan_id").alias("id")), now)
    slugs = rows.where("action <> 'touch'").select("plan_id", F.explode("category_slugs").alias("slug"))
    return state | {
        "plans": plans,
        "plan_sources": merge_provenance(state["plan_sources"], rows, source_id, now, top_link),
        "plan_categories": link_categories(state["plan_categories"], slugs, state["categories"]),
    }


#: Columns of provenance that a record brings along, if its source has them.
BROUGHT = ("source_url", "source_created_at", "source_updated_at")


def merge_provenance(provenance: DataFrame, rows: DataFrame, source_id: int, now: str, top: int | None = None) -> DataFrame:
    """Provenance after a batch of ``upsert_outcomes``: new links, what changed payloads bring, and last-seen times of all.

    A link with an equal payload takes over the source's time of update only.
    """
    brought = [c for c in BROUGHT if c in rows.columns]
    last = rows.withColumn("_r", F.row_number().over(Window.partitionBy("record_id").orderBy(F.col("pos").desc()))).where("_r = 1")
    new = last.select(
        F.col("record_id").alias("source_record_id"), F.lit(source_id).cast("long").alias("source_id"), F.col("plan_id").alias("_plan"), F.col("payload").alias("_payload"), "pos", F.lit(True).alias("_hit"),
        *(F.col(c).cast("string").alias(f"_{c}") for c in brought),
    )
    both = provenance.join(new.drop("pos"), ["source_id", "source_record_id"], "left")
    hit = F.coalesce("_hit", F.lit(False))
    changed = hit & ~F.col("_payload").eqNullSafe(F.col("source_payload_json"))
    kept = both.withColumns(
        {
            "imported_at": F.when(changed, F.lit(now)).otherwise(F.col("imported_at")),
            "source_payload_json": F.when(changed, F.col("_payload")).otherwise(F.col("source_payload_json")),
            "last_seen_at": F.when(hit, F.lit(now)).otherwise(F.col("last_seen_at")),
        }
        | {c: F.when(hit if c == "source_updated_at" else changed, F.col(f"_{c}")).otherwise(F.col(c)) for c in brought}
    ).select(*provenance.columns)
    #: Only keys are numbered; the rest of a link moves once.
    unknown = rows.groupBy(F.col("record_id").alias("source_record_id")).agg(F.max("pos").alias("pos")).withColumn("source_id", F.lit(source_id).cast("long"))
    unknown = unknown.join(provenance.select("source_id", "source_record_id"), ["source_id", "source_record_id"], "left_anti")
    ids = numbered(unknown, provenance if top is None else top, "pos").select(F.col("source_record_id").alias("_record"), "id")
    fresh = new.join(ids, F.col("source_record_id").eqNullSafe(F.col("_record"))).withColumns({"plan_id": F.col("_plan"), "source_payload_json": F.col("_payload"), "imported_at": F.lit(now), "last_seen_at": F.lit(now)} | {c: F.col(f"_{c}") for c in brought})
    missing = [c for c in provenance.columns if c not in fresh.columns]
    fresh = fresh.withColumns({c: F.lit(None).cast(provenance.schema[c].dataType) for c in missing}) if missing else fresh
    return kept.unionByName(fresh.select(*provenance.columns))


def link_categories(links: DataFrame, slugs: DataFrame, categories: DataFrame) -> DataFrame:
    """Links and those of ``slugs`` (plan_id, slug) whose slug is known, each once."""
    new = slugs.join(categories.select("slug", F.col("id").alias("category_id")), "slug").select("plan_id", "category_id")
    return links.select("plan_id", "category_id").union(new).dropDuplicates(["plan_id", "category_id"])


def purge(state: dict[str, DataFrame], where: Column) -> tuple[dict[str, DataFrame], DataFrame]:
    """State without the plans that ``where`` selects and all that hangs on them; and the counts."""
    gone = state["plans"].where(where).select(F.col("id").alias("plan_id"))
    out, counts = dict(state), [gone.agg(F.lit("plans").alias("relation"), F.count("*").alias("n"))]
    out["plans"] = state["plans"].join(gone.withColumnRenamed("plan_id", "id"), "id", "left_anti")
    for name in ("plan_sources", "plan_categories"):
        counts.append(state[name].join(gone, "plan_id", "left_semi").agg(F.lit(name).alias("relation"), F.count("*").alias("n")))
        out[name] = state[name].join(gone, "plan_id", "left_anti")
    if "images" in state:
        lost = state["plan_sources"].join(gone, "plan_id", "left_semi").select(F.col("id").alias("plan_source_id"))
        out["images"] = state["images"].join(lost, "plan_source_id", "left_anti")
    return out, counts[0].union(counts[1]).union(counts[2])


def purge_old(state: dict[str, DataFrame], now: datetime, retention_days: int = 0) -> tuple[dict[str, DataFrame], DataFrame]:
    """The three purges one after another: faulty dates, expired, outside the territory.

    A plan goes by the first that applies, which is found once for all relations; the report has each policy and relation.
    """
    invalid, old = P.coherence_issue(clock.local_date(now).year).isNotNull(), P.expired(clock.retention_cutoff(now, retention_days))
    policy = F.when(invalid, "invalid").when(old, "expired").when(P.outside_territory(), "outside")
    gone = settled(state["plans"].select(F.col("id").alias("plan_id"), policy.alias("policy")).where("policy is not null"))
    out = dict(state)
    out["plans"] = state["plans"].join(gone.select(F.col("plan_id").alias("id")), "id", "left_anti")
    lost = {"plans": gone}
    for name in ("plan_sources", "plan_categories"):
        lost[name] = state[name].join(gone, "plan_id")
        out[name] = state[name].join(gone, "plan_id", "left_anti")
    if "images" in state:
        out["images"] = state["images"].join(lost["plan_sources"].select(F.col("id").alias("plan_source_id")), "plan_source_id", "left_anti")
    counts = None
    for name, rows in lost.items():
        each = rows.groupBy("policy").agg(F.count("*").alias("c")).withColumn("relation", F.lit(name))
        counts = each if counts is None else counts.unionByName(each)
    every = gone.sparkSession.createDataFrame([(p, n) for p in ("invalid", "expired", "outside") for n in lost], "policy string, relation string")
    return out, every.join(counts, ["policy", "relation"], "left").select("policy", "relation", F.coalesce("c", F.lit(0)).alias("n"))


def reconciliation_candidates(provenance: DataFrame, plans: DataFrame, source_id: int, today: str, last: str) -> DataFrame:
    """Links of the source to plans, active or not, that overlap today to the last day."""
    end = F.coalesce("end_date", "start_date")
    live = plans.where((end >= today) & (F.col("start_date") <= last)).select(F.col("id").alias("plan_id"))
    return provenance.where(F.col("source_id") == source_id).join(live, "plan_id", "left_semi")


def missing_links(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """Candidates whose record the complete feed (``seen``: event_id) doesn't have."""
    return candidates.join(seen.select(F.col("event_id").cast("string").alias("source_record_id")), "source_record_id", "left_anti")


def remove_links(state: dict[str, DataFrame], lost: DataFrame, now: str) -> dict[str, DataFrame]:
    """State without the links ``lost`` (id, plan_id) and their images; their plans stay active only if another link remains."""
    out = dict(state)
    out["plan_sources"] = state["plan_sources"].join(lost.select("id"), "id", "left_anti")
    if "images" in state:
        out["images"] = state["images"].join(lost.select(F.col("id").alias("plan_source_id")), "plan_source_id", "left_anti")
    left = out["plan_sources"].groupBy(F.col("plan_id").alias("id")).agg(F.count("*").alias("_left"))
    hit = state["plans"].join(lost.select(F.col("plan_id").alias("id"), F.lit(True).alias("_hit")).distinct(), "id", "left").join(left, "id", "left")
    touched, remains = F.coalesce("_hit", F.lit(False)), F.coalesce("_left", F.lit(0)) > 0
    back = touched & remains & ((F.col("status") == "inactive") | F.col("inactive_at").isNotNull())
    off = touched & ~remains
    out["plans"] = hit.withColumns(
        {
            "updated_at": F.when(back | off, F.lit(now)).otherwise(F.col("updated_at")),
            "inactive_at": F.when(back, None).when(off, F.lit(now)).otherwise(F.col("inactive_at")),
            "status": F.when(back, "active").when(off, "inactive").otherwise(F.col("status")),
        }
    ).select(*state["plans"].columns)
    return out


def find_record(provenance: DataFrame, plans: DataFrame, source_id: int) -> DataFrame:
    """(source_link_id, source_record_id, plan_id, plan_title, plan_status) of each of a source's records."""
    titled = plans.select(F.col("id").alias("plan_id"), F.coalesce("title_ca", "title_es", "original_title").alias("plan_title"), F.col("status").alias("plan_status"))
    mine = provenance.where(F.col("source_id") == source_id).select(F.col("id").alias("source_link_id"), "source_record_id", "plan_id")
    return mine.join(titled, "plan_id").select("source_link_id", "source_record_id", "plan_id", "plan_title", "plan_status")


def remove_event(state: dict[str, DataFrame], source_id: int, event_id: str, now: str, purge_plan: bool = False, dry_run: bool = False) -> tuple[dict[str, DataFrame], str]:
    """Removes one record's provenance; with ``purge_plan`` also a plan that nothing else supports.

    Result: not-found, removed or purged (of a dry run: what would happen, and the state as it was).
    """
    lost = state["plan_sources"].where((F.col("source_id") == source_id) & (F.col("source_record_id") == event_id)).select("id", "plan_id")
    row = lost.head(1)
    if not row:
        return state, "not-found"
    plan = row[0]["plan_id"]
    after = remove_links(state, lost, now)
    alone = not after["plan_sources"].where(F.col("plan_id") == plan).head(1)
    if purge_plan and alone:
        after, _ = purge(after, F.col("id") == plan)
    return (state if dry_run else after), "purged" if purge_plan and alone else "removed"


def inactive_audit(plans: DataFrame, provenance: DataFrame, now: datetime, days: int = 7) -> DataFrame:
    """Inactive plans with n_sources, days and reason: has-source, no-timestamp, too-recent or eligible."""
    links = provenance.groupBy(F.col("plan_id").alias("id")).agg(F.count("*").alias("n"))
    rows = plans.where(F.col("status") == "inactive").join(links, "id", "left").withColumn("n_sources", F.coalesce("n", F.lit(0)))
    at = F.lit(now.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    age = F.floor((F.unix_timestamp(at) - F.unix_timestamp(F.try_to_timestamp("inactive_at"))) / 86400)
    reason = F.when(F.col("n_sources") > 0, "has-source").when(F.col("inactive_at").isNull(), "no-timestamp").when(F.col("inactive_at") > clock.inactive_cutoff(now, days), "too-recent").otherwise("eligible")
    return rows.select("id", "inactive_at", "n_sources", age.alias("days"), reason.alias("reason"))


#: Relations whose rows hang on a plan and that ``purge_inactive`` takes into account.
DEPENDENT = ("plan_sources", "plan_categories")


def check_dependencies(state: dict[str, DataFrame]) -> None:
    """Raises unless plans can be deleted without leaving rows that refer to them."""
    missing = {"id", "status", "inactive_at"} - set(state["plans"].columns)
    if missing:
        raise ValueError(f"plans lacks {', '.join(sorted(missing))}")
    unknown = sorted(n for n, df in state.items() if n not in ("plans", *DEPENDENT) and "plan_id" in df.columns)
    if unknown:
        raise ValueError(f"{', '.join(unknown)} depends on plans in a way that is not handled")


def purge_inactive(state: dict[str, DataFrame], now: datetime, days: int = 7, dry_run: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """Deletes what the audit finds eligible; a dry run only reports."""
    check_dependencies(state)
    audit = inactive_audit(state["plans"], state["plan_sources"], now, days)
    if dry_run:
        return state, audit
    gone = audit.where("reason = 'eligible'").select("id")
    out = dict(state)
    out["plans"] = state["plans"].join(gone, "id", "left_anti")
    out["plan_categories"] = state["plan_categories"].join(gone.withColumnRenamed("id", "plan_id"), "plan_id", "left_anti")
    return out, audit


ROLES = {"card": (640, 360), "detail": (1136, 639)}
IMAGE_COLUMNS = ("url", "ratio", "width", "height", "is_fallback", "attribution")


def best_image_per_role(images: DataFrame, owner: str) -> DataFrame:
    """Of each owner's valid images the best for each role: 16:9, no fallback, nearest in size, narrowest, first URL, least id (if there is one)."""
    spark = images.sparkSession
    roles = spark.createDataFrame([(r, w, h) for r, (w, h) in ROLES.items()], "role string, w int, h int")
    apart = F.abs(F.col("width") - F.col("w")) + F.abs(F.col("height") - F.col("h"))
    rank = F.row_number().over(Window.partitionBy(owner, "role").orderBy((F.coalesce(F.col("ratio"), F.lit("")) != "16_9").cast("int"), "is_fallback", apart, "width", "url", *(["id"] if "id" in images.columns else [])))
    return images.where(P.https_image()).crossJoin(F.broadcast(roles)).withColumn("n", rank).where("n = 1").drop("n", "w", "h")


def image_actions(stored: DataFrame, chosen: DataFrame) -> DataFrame:
    """(plan_source_id, role, action): created, updated, unchanged or removed; only owners in ``chosen`` lose images."""
    keys = ["plan_source_id", "role"]
    old = stored.join(chosen.select("plan_source_id").distinct(), "plan_source_id", "left_semi").select(*keys, F.struct(*IMAGE_COLUMNS).alias("old"))
    both = old.join(chosen.select(*keys, F.struct(*IMAGE_COLUMNS).alias("new")), keys, "full")
    action = F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("updated")
    return both.select(*keys, action.alias("action"))


def images_due(links: DataFrame, images: DataFrame, cutoff: str, force: bool = False) -> DataFrame:
    """Links to refresh: fewer than two images, one never seen, or the oldest seen by the cutoff."""
    seen = images.groupBy(F.col("plan_source_id").alias("id")).agg(F.count("*").alias("n_images"), F.min("last_seen_at").alias("oldest"))
    rows = links.join(seen, "id", "left").withColumn("n_images", F.coalesce("n_images", F.lit(0)))
    due = (F.col("n_images") < 2) | F.col("oldest").isNull() | (F.col("oldest") <= cutoff)
    return rows if force else rows.where(due)


def cache_evictions(files: DataFrame, now: str, ttl_hours: int, max_bytes: int, valid: DataFrame) -> DataFrame:
    """Files (image_id, size, fetched_at) with action: orphan, expired, evicted (oldest first, to fit) or kept."""
    known = files.join(valid.select("image_id", F.lit(True).alias("_valid")).distinct(), "image_id", "left")
    old = F.to_timestamp("fetched_at") < F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {ttl_hours} HOURS")
    state = F.when(F.col("_valid").isNull(), "orphan").when(old, "expired")
    rows = known.select("image_id", "size", "fetched_at", state.alias("gone"))
    kept = running_sum(rows.where("gone is null"), "size", [F.col("fetched_at").desc(), F.col("image_id").desc()], "newer")
    kept = kept.withColumn("action", F.when(F.col("newer") > max_bytes, "evicted").otherwise("kept"))
    return kept.select("image_id", "size", "fetched_at", "action").union(rows.where("gone is not null").select("image_id", "size", "fetched_at", F.col("gone").alias("action")))


def cache_summary(actions: DataFrame) -> DataFrame:
    """One row of what ``cache_evictions`` did: orphaned, expired, evicted, and the bytes that stay."""
    is_ = lambda x: F.count_if(F.col("action") == x)
    left = F.coalesce(F.sum(F.when(F.col("action") == "kept", F.col("size"))), F.lit(0))
    return actions.agg(is_("orphan").alias("orphaned"), is_("expired").alias("expired"), is_("evicted").alias("evicted"), left.alias("bytes"))


def cache_hits(files: DataFrame, images: DataFrame, now: str, ttl_hours: int) -> DataFrame:
    """Cached files (image_id, source_hash, fetched_at) that may still be served: of the image's present URL, and younger than the limit."""
    current = images.select(F.col("id").alias("image_id"), F.sha2("url", 256).alias("_hash"))
    fresh = F.to_timestamp("fetched_at") > F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {ttl_hours} HOURS")
    return files.join(current, "image_id").where((F.col("source_hash") == F.col("_hash")) & fresh).drop("_hash")


def run_counts(outcomes: DataFrame) -> DataFrame:
    """One row of a run's counters; ``outcome`` invalid counts as skipped too."""
    is_ = lambda x: F.count_if(F.col("outcome") == x)
    return outcomes.agg(F.count("*").alias("fetched"), is_("inserted").alias("inserted"), is_("updated").alias("updated"), (is_("skipped") + is_("invalid")).alias("skipped"), is_("invalid").alias("invalid"), is_("error").alias("errors"))


def started_run(spark, run_id: int, source_id: int, started: str) -> DataFrame:
    """The ledger's row of a run that has begun."""
    row = spark.range(1).select(F.lit(run_id).cast("long").alias("id"), F.lit(source_id).cast("long").alias("source_id"), F.lit(started).alias("started_at"))
    none = {"finished_at": "string", "status": "string", "fetched": "long", "inserted": "long", "updated": "long", "skipped": "long", "invalid": "long", "errors": "long", "invalid_details": "string"}
    counts = {n: (F.lit(0) if t == "long" else F.lit(None)).cast(t) for n, t in none.items()}
    return row.withColumns(counts | {"status": F.lit("running")})


def ledger_row(counts: DataFrame, invalid: DataFrame, run_id: int, source_id: int, started: str, finished: str) -> DataFrame:
    """A finished run with its counters and, as JSON, the first hundred invalid records."""
    some = invalid.orderBy("record_id").limit(100).agg(F.to_json(F.array_sort(F.collect_list(F.struct("record_id", "reason")))).alias("invalid_details"))
    status = F.when(F.col("errors") > 0, "completed_with_errors").otherwise("completed")
    return counts.crossJoin(F.broadcast(some)).select(F.lit(run_id).alias("id"), F.lit(source_id).alias("source_id"), F.lit(started).alias("started_at"), F.lit(finished).alias("finished_at"), status.alias("status"), *counts.columns, "invalid_details")
