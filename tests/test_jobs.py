import json
import re
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from eventide import import_queries
from eventide.functions.session import released, settled, shared_folder
from eventide.functions.sql import register_functions
from eventide.operators import feed as feeds
from eventide.operators import jobs, normalize, predicates
from eventide.operators.feed import Policy
from eventide.plans.schemas import AGENDA_FIELDS, TABLES, seeded_categories
from eventide.sources import readers, snapshot
from eventide.sources.ledger import RunLedger
from eventide.testdata import relation

from .test_catalogue import NOW, plans


@pytest.fixture
def empty(spark):
    st = {n: spark.createDataFrame([], s) for n, s in TABLES.items()}
    row = lambda i, key: (i, key, key, "p", "CC", "https://l", "by", 1, 1, "2026-01-01", 1)
    return st | {"sources": spark.createDataFrame([row(1, "agenda"), row(2, "feed")], TABLES["sources"]), "categories": seeded_categories(spark)}


def agenda(spark, *rows):
    base = {"denominaci": "Concert", "data_inici": "2026-08-20", "data_fi": "2026-08-20", "municipi": "agenda:ubicacions/girona/baix-emporda/palafrugell", "tags_mbits": "ambits/musica", "espai": "Teatre"}
    full = [base | {"codi": str(i)} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([(i, *(r.get(f) for f in AGENDA_FIELDS)) for i, r in enumerate(full)], "pos long, " + ", ".join(f"{f} string" for f in AGENDA_FIELDS))


def stored(spark, st, tmp_path):
    snapshot.write_snapshot(spark, st, str(tmp_path))
    return snapshot.read_snapshot(spark, str(tmp_path))


def test_agenda_import_counts_and_repeats(spark, empty, tmp_path):
    records = agenda(
        spark, {}, {"denominaci": "Far", "data_inici": "2099-01-01", "data_fi": "2099-01-01"}, {"denominaci": "Back", "data_fi": "2026-08-01"}, {"denominaci": "Old", "data_inici": "2020-01-01", "data_fi": "2020-01-02"},
        {"denominaci": "Always", "data_inici": "2020-01-01", "data_fi": "2020-01-02", "permanent": "Sí"}, {"denominaci": None}, {"denominaci": "El concert"},
    )
    after, invalid, counts = jobs.import_agenda(records, empty, NOW)
    assert counts == {"fetched": 7, "inserted": 2, "updated": 1, "skipped": 4, "invalid": 2, "errors": 0}
    assert {r["reason"] for r in invalid.collect()} == {"EXTREME_FUTURE_DATE", "END_BEFORE_START"}
    st = stored(spark, after, tmp_path)
    assert (st["plans"].count(), st["plan_sources"].count(), st["plan_categories"].count()) == (2, 3, 2)
    again, _, counts = jobs.import_agenda(records, st, NOW)
    assert counts | {"skipped": 0, "invalid": 0} == {"fetched": 7, "inserted": 0, "updated": 0, "skipped": 0, "invalid": 0, "errors": 0}
    assert again["plans"].select("id", "updated_at").exceptAll(st["plans"].select("id", "updated_at")).count() == 0


def test_ledger_has_errors_invalid_records_and_failures(spark, empty, tmp_path):
    ledger = RunLedger(spark, str(tmp_path / "runs"), lambda: NOW)
    records = agenda(spark, {}, {"denominaci": "Poisoned", "horari": "a&#99999999;b"}, {"denominaci": "Back", "data_fi": "2026-08-01"}, {"denominaci": "Good", "horari": "10 &amp;#233; h", "data_creacio": "2026-01-01", "urlactivitat": "https://a"})
    after, _, counts = jobs.import_agenda(records, empty, NOW, ledger=ledger)
    assert counts == {"fetched": 4, "inserted": 2, "updated": 0, "skipped": 1, "invalid": 1, "errors": 1}
    assert {r["schedule_text"] for r in after["plans"].collect()} == {None, "10 é h"}
    link = after["plan_sources"].where("source_url = 'https://a'").first()
    assert link["source_created_at"] == "2026-01-01"
    run = ledger.read().first()
    assert (run["id"], run["status"], run["errors"], run["error_message"]) == (1, "completed_with_errors", 1, None)
    assert json.loads(run["invalid_details"]) == [{"source_record_id": "2", "title": "Back", "reason": "END_BEFORE_START", "start_date": "2026-08-20", "end_date": "2026-08-01"}]

    def broken():
        raise OSError("network failure")

    with pytest.raises(OSError, match="network"):
        jobs.import_feed(broken, after, NOW, POLICY, ledger=ledger)
    run = ledger.read().where("id = 2").first()
    assert (run["status"], run["errors"], run["error_message"], run["finished_at"] is None) == ("failed", 1, "network failure", False)
    assert ledger.read().count() == 2


def test_unapproved_sources_are_refused(spark, empty):
    with pytest.raises(jobs.NotApproved, match="missing"):
        jobs.import_agenda(agenda(spark, {}), empty, NOW, source="other")
    off = empty | {"sources": empty["sources"].withColumn("enabled", F.lit(0))}
    with pytest.raises(jobs.NotApproved, match="disabled"):
        jobs.import_agenda(agenda(spark, {}), off, NOW)


POLICY = Policy("Box")


def feed(spark, tmp_path, name, *rows):
    base = {"eventName": "Concert", "source": "trium", "brandName": "Box", "officialSeller": True, "eventStartLocalDate": "2026-08-20", "eventStartLocalTime": "20:00", "venue": {"venueName": "Teatre", "countryCode": "ES", "state": "Girona", "city": "Palafrugell", "latitude": 42.0, "longitude": 3.0}}
    (tmp_path / name).write_text(json.dumps([base | {"eventId": f"e{i}"} | r for i, r in enumerate(rows)]))
    return readers.read_feed(spark, str(tmp_path / name))


def test_feed_import_merges_repeats_and_reconciles(spark, empty, tmp_path):
    st = stored(spark, jobs.import_agenda(agenda(spark, {}), empty, NOW)[0], tmp_path / "a")
    both = ({}, {"eventStartLocalTime": "18:00"}, {"eventName": "Ball", "eventStartLocalDate": "2026-08-21"}, {"source": "universe"}, {"eventStartLocalDate": "2027-08-21"}, {"brandName": "Other"}, {"officialSeller": "true"}, {"eventName": " "}, {"eventName": ""})
    records = feed(spark, tmp_path, "f.json", *both)
    dry, n, _ = jobs.import_feed(records, st, NOW, POLICY, dry_run=True)
    assert dry is st and (n["new_plans"], n["updates"], n["confirmed_merges"], n["unchanged"]) == (1, 0, 1, 0)
    assert (n["records"], n["accepted"], n["excluded_universe"], n["excluded_other"], n["out_of_horizon"], n["invalid"], n["candidates"]) == (9, 6, 1, 2, 1, 2, 4)
    after, n, _ = jobs.import_feed(records, st, NOW, POLICY)
    assert (n["new_plans"], n["updates"], n["confirmed_merges"], n["unchanged"], n["removals"]) == (1, 1, 1, 0, 0)
    new = stored(spark, after, tmp_path / "b")
    assert new["plans"].count() == 2 and new["plan_sources"].count() == 4
    merged = new["plans"].where("original_title = 'Concert'").first()
    assert (merged["schedule_text"], merged["latitude"]) == ("18:00, 20:00", 42.0)
    ball = new["plans"].where("original_title = 'Ball'").first()
    assert (ball["title_ca"], ball["title_es"], ball["locality"], ball["kind"]) == ("Ball", "Ball", "Palafrugell", "event")
    later = NOW + timedelta(hours=1)
    n = jobs.import_feed(records, new, later, POLICY)[1]
    assert (n["new_plans"], n["updates"], n["unchanged"]) == (0, 0, 2)
    lost, n, details = jobs.import_feed(feed(spark, tmp_path, "g.json", {}), new, later, POLICY)
    assert {r["original_title"]: r["status"] for r in lost["plans"].collect()} == {"Concert": "active", "Ball": "inactive"}
    assert lost["plan_sources"].count() == 2 and n["removals"] == 2 == details["removals"].count()


def test_known_feed_records_overwrite_their_plan(spark, empty, tmp_path):
    first = ({"eventName": "Music Ball", "eventInfo": "old", "priceRange": "10 EUR"}, {"eventName": "Jazz", "segmentName": "Music", "genreName": {"name": "Family"}}, {"eventName": "Same", "images": [{"url": "a"}]})
    st = stored(spark, jobs.import_feed(feed(spark, tmp_path, "f.json", *first), empty, NOW, POLICY)[0], tmp_path / "a")
    slugs = st["plan_categories"].join(st["categories"], F.col("category_id") == F.col("id")).join(st["plans"].select(F.col("id").alias("plan_id"), "original_title"), "plan_id")
    assert sorted((r["original_title"], r["slug"]) for r in slugs.collect()) == [("Jazz", "familia"), ("Jazz", "musica")]
    changed = (first[0] | {"eventInfo": None, "eventStatus": "cancelled", "eventStartLocalTime": "22:30", "priceRange": None}, first[1] | {"venue": {"venueName": "Teatre", "countryCode": "ES", "state": "Girona", "city": "Palafrugell", "latitude": 42.0, "longitude": 3.0, "address": {"line1": "Street 1"}}}, {"eventName": "Same", "images": [{"url": "b"}, 1]})
    after, n, _ = jobs.import_feed(feed(spark, tmp_path, "g.json", *changed), st, NOW + timedelta(hours=1), POLICY)
    assert (n["new_plans"], n["updates"], n["unchanged"]) == (0, 2, 1)
    ball, jazz, same = after["plans"].orderBy("id").collect()
    assert (ball["status"], ball["schedule_text"], ball["description_ca"], ball["price_text"]) == ("cancelled", "22:30", None, None)
    assert jazz["address"] == "Street 1" and jazz["updated_at"] != jazz["created_at"] and same["updated_at"] == same["created_at"]


def test_groups_follow_the_record_before(spark, empty, tmp_path):
    """A new record of a group goes to the plan of the one before it, even where the group's first plan is another."""
    st = stored(spark, jobs.import_feed(feed(spark, tmp_path, "f.json", {}, {"eventName": "Ball"}), empty, NOW, POLICY)[0], tmp_path / "a")
    later = ({}, {"eventInfo": "x"}, {}, {"eventStartLocalTime": "18:00"})
    after, n, _ = jobs.import_feed(feed(spark, tmp_path, "g.json", *later), st, NOW, POLICY)
    plan = {r["source_record_id"]: r["plan_id"] for r in after["plan_sources"].collect()}
    assert plan["e0"] != plan["e1"] == plan["e2"] == plan["e3"] and (n["unchanged"], n["updates"], n["new_plans"]) == (1, 0, 0)
    rows = {r["id"]: r for r in after["plans"].collect()}
    assert rows[plan["e0"]]["schedule_text"] == "20:00" and rows[plan["e1"]]["original_title"] == "Ball"


def test_variant_of_a_denied_event_and_rows_without_a_name(spark, empty, tmp_path):
    records = feed(spark, tmp_path, "f.json", {}, {"eventName": "Concert | Paquetes VIP"}, {"eventName": ""}, {"eventName": "Ball", "eventEndLocalDate": "soon"})
    after, n, _ = jobs.import_feed(records, empty, NOW, Policy("Box", denied=("e0",)))
    assert [(r["original_title"], r["end_date"]) for r in after["plans"].collect()] == [("Ball", "2026-08-20")]
    assert (n["denied"], n["variants"], n["invalid"]) == (1, 1, 1)


def test_a_crowd_of_equal_plans_is_shared_out(spark):
    """20,000 plans of one title, town and day on either side: minima and counts, no pairs."""
    base = spark.range(20_000, numPartitions=4).select(
        "id", F.lit("2026-08-20").alias("start_date"), F.lit("Olot").alias("municipality"), F.lit("Ball").alias("original_title"), F.concat(F.lit("v"), (F.col("id") % 7000).cast("string")).alias("venue_name"), F.lit(None).cast("string").alias("address"),
        (F.lit(42.0) + (F.col("id") % 100) / 1e4).alias("latitude"), (F.lit(2.0) + F.floor(F.col("id") / 100) / 1e4).alias("longitude"),
    )
    others = base.withColumn("id", F.col("id") + 5000).withColumns({"venue_name": F.when(F.col("id") % 2 == 0, F.col("venue_name")), "latitude": F.col("latitude") + 0.05})
    rows = {r["id"]: r for r in feeds.cross_source_matches(base, others).collect()}
    assert len(rows) == 20_000
    for i in (0, 1, 4999, 13_001):
        candidates = [j for j in range(20_000) if (j + 5000) % 2 == 0 and j % 7000 == i % 7000]
        want = min(candidates) + 5000 if candidates else None
        assert (rows[i]["confirmed"], rows[i]["n_possible"]) == (want, want - 5000 if want else 20_000)


def test_long_titles_do_not_move_with_a_match(spark):
    """Titles of 20,000 characters that differ in the last one; points at all distances around the tolerance."""
    long, spot = "ball " * 4000, "id long, original_title string, start_date string, municipality string, venue_name string, address string, latitude double, longitude double"
    plan = lambda i, title, lat=None, lon=None: (i, title, "2026-08-20", "Olot", None, None, lat, lon)
    rows = spark.createDataFrame([plan(1, long + "a", 42.0, 2.0), plan(2, long + "b", 42.0, 2.0), plan(3, None)], spot)
    others = spark.createDataFrame([plan(11, long + "A", 42.0, 2.0), plan(12, None)], spot)
    assert max(len(v) for r in feeds._placed(rows).collect() for v in r if isinstance(v, (str, bytes, bytearray))) <= 64
    assert sorted(map(tuple, feeds.cross_source_matches(rows, others).collect())) == [(1, 11, 0), (3, None, 1)]
    steps = [(i, j) for i in range(-5, 6) for j in range(-5, 6)]
    near = spark.createDataFrame([plan(n, "Ball", 42.0007 + n % 7 * 0.00131, -0.0003 + n % 7 * 0.00171) for n in range(7)], spot)
    points = [(100 + n, 42.0 + i * 0.0011, j * 0.0011) for n, (i, j) in enumerate(steps)]
    got = {r["id"]: r["confirmed"] for r in feeds.cross_source_matches(near, spark.createDataFrame([plan(n, "Ball", a, b) for n, a, b in points], spot)).collect()}
    assert got == {r["id"]: min((n for n, a, b in points if abs(a - r["latitude"]) <= 0.002 and abs(b - r["longitude"]) <= 0.002), default=None) for r in near.collect()}


def test_tags_are_folded_once_for_all_categories(spark):
    rows = spark.createDataFrame([("Ámbits/Jazz", "agenda:categories/Museus"), (None, None)], "a string, b string").select(normalize.agenda_categories(F.col("a"), F.col("b")).alias("x"))
    assert [r["x"] for r in rows.collect()] == [["musica", "museus"], []]
    assert rows._jdf.queryExecution().analyzed().toString().count("translate(") == 1


def test_the_funnel_is_code_that_the_jvm_compiles(spark, capsys):
    """HotSpot interprets a method of more than 8,000 bytes."""
    r = lambda name: relation(spark, "/root/testdata/sf0.001", name)
    feeds.funnel(import_queries.feed_full(r).withColumn("province", F.lit(None).cast("string")), "2024-01-02", "2024-02-01", import_queries.POLICY).explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= 8000


def test_image_sync(spark, empty, tmp_path):
    st = stored(spark, jobs.import_feed(feed(spark, tmp_path, "f.json", {}), empty, NOW, POLICY)[0], tmp_path / "a")
    offered = spark.createDataFrame([("e0", "https://i/1", "16_9", 640, 360, 0, None), ("e0", "https://i/2", "16_9", 1136, 639, 0, "by")], "event_id string, url string, ratio string, width int, height int, is_fallback int, attribution string")
    one, counts = jobs.sync_images(st, offered, NOW)
    assert {r["action"]: r["n"] for r in counts.collect()} == {"created": 2}
    st = stored(spark, one, tmp_path / "b")
    assert jobs.sync_images(st, offered, NOW + timedelta(hours=1))[1].count() == 0
    assert {r["action"]: r["n"] for r in jobs.sync_images(st, offered, NOW, force=True)[1].collect()} == {"unchanged": 2}


def test_home(spark, empty):
    rows = plans(spark, {"start_date": "2026-08-21", "end_date": "2026-08-21"}, {"start_date": "2026-08-25", "end_date": "2026-08-25"}, {"permanent": 1})
    page = jobs.home(empty | {"plans": rows}, datetime(2026, 8, 20).date(), datetime(2026, 8, 20, 9, tzinfo=timezone.utc))
    assert {k: sorted(r["id"] for r in page[k].collect()) for k in ("weekend", "upcoming", "permanent")} == {"weekend": [1, 3], "upcoming": [2], "permanent": [3]}
    assert page["categories"].count() == 8


def test_sql_functions_equal_the_columns(spark):
    register_functions(spark)
    rows = plans(spark, {"province": "Fora d’Espanya", "start_date": "2016-02-29", "end_date": "2026-03-02"}, {"locality": "Sant Àgata", "start_date": "2026-02-30"}, {"start_date": "2026-01-01", "end_date": "2026-01-02"}, {"start_date": "x", "kind": "place"})
    got = rows.select(
        F.expr("is_outside_territory(province, comarca, municipality, locality)").alias("a"), predicates.outside_territory().alias("b"),
        F.expr("is_temporally_invalid(kind, permanent, start_date, end_date, 2026)").alias("c"), predicates.coherence_issue(2026).isNotNull().alias("d"), F.expr("normalize_location(locality)").alias("e"),
    ).collect()
    assert all(r["a"] == r["b"] and r["c"] == r["d"] for r in got) and got[1]["e"] == "sant-agata" and got[0]["e"] == ""


def test_what_is_kept_is_packed_and_released(spark):
    folder = Path(shared_folder(spark).removeprefix("file://"))
    before = set(folder.glob("*"))
    rows = spark.range(20_000).selectExpr("id", "repeat('text ', 100) AS body", "named_struct('a', id) AS record", "CAST('2026-08-17' AS DATE) AS day", "array(CAST(id AS DECIMAL(20, 2))) AS sums")
    kept = settled(rows.repartition("id"))
    (made,) = set(folder.glob("*")) - before
    assert sum(p.stat().st_size for p in made.rglob("*")) < 1_000_000
    assert kept.dtypes == rows.dtypes and kept.exceptAll(rows).count() == 0 and kept.count() == 20_000
    released(kept)
    assert not made.exists()
    odd = settled(rows.limit(3).selectExpr("id", "NULL AS nothing", "INTERVAL 1 DAY AS long"))
    released(odd)
    assert odd.count() == 3


def test_an_import_keeps_no_record_twice(spark, empty):
    """What was fetched goes when its plans are kept, and these have the payload, not the record beside it."""
    folder = Path(shared_folder(spark).removeprefix("file://"))
    before = set(folder.glob("settled-*"))
    after, _, counts = jobs.import_agenda(agenda(spark, *({"denominaci": f"Concert {i}"} for i in range(30))), empty, NOW)
    kept = [spark.read.parquet(str(p)).columns for p in set(folder.glob("settled-*")) - before]
    assert kept and not [c for c in kept if "record" in c or "denominaci" in c]
    assert sum("payload" in c and "title_ca" in c for c in kept) == 2 and counts["inserted"] == 30
    assert sorted(r["id"] for r in after["plan_sources"].collect()) == list(range(1, 31))
