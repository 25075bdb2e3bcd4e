import gzip
import json
import re
import sqlite3
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from eventide.config import Settings
from eventide.operators import normalize, predicates, present, search, state
from eventide.plans import versions
from eventide.plans.schemas import AGENDA_FIELDS, TABLES, seeded_categories
from eventide.sources import readers, snapshot
from eventide.sources.buckets import BucketStore
from eventide.sources.search_index import SearchIndex, write_index
from eventide.sources.sitemap import write_sitemap
from eventide.streaming.ingest import stream_agenda
from eventide.testdata import relation

from .test_catalogue import NOW, plans

RECORD = {
    "codi": "1", "denominaci": "Concert d’estiu", "descripcio": "text", "data_inici": "2026-08-17T00:00", "municipi": "agenda:ubicacions/girona/baix-emporda/palafrugell",
    "gratuita": "Sí", "tags_categor_es": "agenda:categories/concerts,familiar", "latitud": "41.9", "longitud": "3.1", "urlactivitat": "ftp://x", "url": "https://a.example/", "imatges": "x",
}


def test_agenda_records_to_plans(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([RECORD, {"codi": "2"}, {"denominaci": "x"}]))
    rows = normalize.agenda_plans(readers.read_agenda(spark, str(tmp_path / "a.json"))).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["province"], r["comarca"], r["municipality"]) == ("Girona", "Baix Emporda", "Palafrugell")
    assert r["fingerprint"] == "concert-estiu|palafrugell|2026-08-17"
    assert (r["is_free"], r["image_url"], r["category_slugs"], r["website_url"]) == (1, None, ["familia", "musica"], "https://a.example/")
    assert r["quality_score"] == 90


def test_restricted_fields_leave(spark):
    row = spark.createDataFrame([tuple(RECORD.get(f) for f in AGENDA_FIELDS)], ", ".join(f"{f} string" for f in AGENDA_FIELDS))
    assert not set(normalize.without_restricted_images(row).columns) & set(normalize.RESTRICTED)


def test_feed_reader_and_gate(spark, tmp_path):
    event = {"eventId": "e1", "eventName": "N", "source": "trium", "officialSeller": True, "eventStartLocalDate": "2026-09-01", "venue": {"venueName": "V", "stateName": "Girona", "lat": 42.0, "lng": 2.5, "countryCode": "ES"}}
    with gzip.open(tmp_path / "f.json.gz", "wt") as f:
        json.dump({"events": [event]}, f)
    row = readers.read_feed(spark, str(tmp_path / "f.json.gz")).first()
    assert (row["event_id"], row["venue_name"], row["state"], row["latitude"], row["end_date"]) == ("e1", "V", "Girona", 42.0, "2026-09-01")
    (tmp_path / "empty.json").write_text("[]")
    with pytest.raises(ValueError, match="empty"):
        readers.read_feed(spark, str(tmp_path / "empty.json"))


def test_snapshot_swaps_at_once(spark, tmp_path):
    empty = {n: spark.createDataFrame([], s) for n, s in TABLES.items()}
    root = str(tmp_path)
    snapshot.write_snapshot(spark, empty | {"categories": seeded_categories(spark)}, root, files=1)
    first = snapshot.read_snapshot(spark, root)["categories"].count()
    snapshot.write_snapshot(spark, empty, root)
    assert first == 18 and snapshot.read_snapshot(spark, root)["categories"].count() == 0


def test_sitemap_sink(spark, tmp_path):
    shown = spark.createDataFrame([(5, "event"), (6, "place")], "id long, kind string")
    folder = tmp_path / "out"
    write_sitemap(search.sitemap_entries(shown, "https://s.example"), f"file://{folder}")
    text = "".join(p.read_text() for p in sorted(folder.glob("*.xml")))
    assert text.count("<url>") == 4 and text.index("<?xml") == 0 and text.rstrip().endswith("</urlset>")
    assert [p.name for p in folder.glob("*.xml")] == ["sitemap.xml"]
    many = spark.range(25, numPartitions=3).select(F.col("id").alias("position"), F.concat(F.lit("<url><loc>"), F.col("id").cast("string"), F.lit("</loc></url>")).alias("line"))
    write_sitemap(many, f"file://{folder}", "https://s.example", most=10)
    index = (folder / "sitemap.xml").read_text()
    named = re.findall(r"https://s.example/(sitemap-[^<]+)", index)
    shown = [int(i) for n in named for i in re.findall(r"<loc>(\d+)</loc>", (folder / n).read_text())]
    assert "<sitemapindex" in index and shown == list(range(25)) and len(list(folder.glob("*.xml"))) == len(named) + 1


def test_a_failed_sitemap_leaves_the_old_one(spark, tmp_path):
    rows = spark.range(2000, numPartitions=4).select(F.col("id").alias("position"), F.lit("<url/>").alias("line"))
    write_sitemap(rows, f"file://{tmp_path}")
    before = {p.name: p.read_bytes() for p in tmp_path.glob("*.xml")}
    broken = rows.withColumn("line", F.when(F.col("position") == 1990, F.raise_error(F.lit("killed"))).otherwise("<other/>"))
    with pytest.raises(Exception, match="killed"):
        write_sitemap(broken, f"file://{tmp_path}")
    assert {p.name: p.read_bytes() for p in tmp_path.glob("*.xml")} == before


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps(RECORD))
    seen = []
    query = stream_agenda(spark, str(tmp_path / "in"), str(tmp_path / "ck"), lambda df, i: seen.extend(r["codi"] for r in df.collect()))
    query.awaitTermination(60)
    assert seen == ["1"]


def answers(where: str, row: dict) -> bool:
    """A row by a conjunction in the endpoint's language, evaluated by SQLite."""
    if not where:
        return True
    names = sorted(set(re.findall(r"\b(codi|denominaci|data_fi|data_inici|permanent)\b", where)))
    select = ", ".join(f":{n} AS {n}" for n in names) or "1"
    db = sqlite3.connect(":memory:")
    db.create_function("starts_with", 2, lambda a, b: a is not None and a.startswith(b))
    return bool(db.execute(f"SELECT count(*) FROM (SELECT {select}) WHERE {where}", {n: None if row.get(n) is None else str(row[n]) for n in names}).fetchone()[0])


class Endpoint(BaseHTTPRequestHandler):
    rows = 25
    where = ""
    asked: dict = {}

    def do_GET(self):
        url = urlparse(self.path)
        code, body, headers = 200, [], {}
        if url.path == "/meta":
            body = {"id": "set", "columns": []}
        elif url.path == "/wrong":
            body = {"id": "other"}
        elif url.path.startswith("/event/"):
            name = url.path.rpartition("/")[2]
            turn = Endpoint.asked[name] = Endpoint.asked.get(name, 0) + 1
            if name == "gone":
                code = 404
            elif name == "slow" or (name == "busy" and turn == 1):
                code, headers = 429, {"retry-after": "0" if name == "busy" else "2"}
            body = {"images": [{"url": f"https://i/{name}", "ratio": "16_9", "width": 640, "height": 360}]}
        else:
            q = parse_qs(url.query)
            first, size = int(q["$offset"][0]), int(q["$limit"][0])
            every = [{"codi": i, "denominaci": f"d{i:02}", "data_fi": f"2026-01-{i + 1:02}"} for i in range(Endpoint.rows)]
            Endpoint.where = q.get("$where", [""])[0]
            body = [r for r in every if answers(Endpoint.where, r)][first : first + size]
        raw = json.dumps(body).encode()
        self.send_response(code)
        for k, v in headers.items():
            self.send_header(k, v)
        self.send_header("content-length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)

    def log_message(self, *a):
        pass


@pytest.fixture
def endpoint():
    server = HTTPServer(("127.0.0.1", 0), Endpoint)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_paged_agenda_reads_all_pages_and_checks_the_metadata(spark, endpoint):
    spark.dataSource.register(readers.PagedAgenda)
    read = lambda **o: spark.read.format("paged_agenda").options(url=f"{endpoint}/rows", pageSize=10, **o).load()
    for options in ({}, {"rows": 25}, {"rows": 12, "metadata": f"{endpoint}/meta", "dataset": "set"}):
        assert sorted(int(r["codi"]) for r in read(**options).collect()) == list(range(25))
    with pytest.raises(Exception, match="metadata"):
        read(metadata=f"{endpoint}/wrong", dataset="set").collect()


def test_filters_go_to_the_endpoint(spark, endpoint):
    read = lambda cutoff=None: readers.agenda_pages(spark, f"{endpoint}/rows", cutoff, pageSize=10)
    rows = [(r["codi"], r["denominaci"], r["data_fi"]) for r in read().collect()]
    asked = {
        "denominaci >= 'd05' AND data_fi < '2026-01-20'": "(denominaci IS NOT NULL) AND (data_fi IS NOT NULL) AND (denominaci >= 'd05') AND (data_fi < '2026-01-20')",
        "codi IN ('3', '7') AND denominaci LIKE 'd0%'": "(denominaci IS NOT NULL) AND (codi IN ('3', '7')) AND (starts_with(denominaci, 'd0'))",
        "denominaci <> 'd''x' AND length(denominaci) > 2": "(denominaci IS NOT NULL) AND (NOT (denominaci = 'd''x'))",
        "permanent IS NULL AND latitud IS NULL": "(permanent IS NULL)",
    }
    for condition, sent in asked.items():
        got = [(r["codi"], r["denominaci"], r["data_fi"]) for r in read().where(condition).collect()]
        want = [(r["codi"], r["denominaci"], r["data_fi"]) for r in spark.createDataFrame(rows, "codi string, denominaci string, data_fi string").withColumns({"permanent": F.lit(None).cast("string"), "latitud": F.lit(None).cast("string")}).where(condition).collect()]
        assert sorted(got) == sorted(want) and sorted(Endpoint.where.split(" AND ")) == sorted(sent.split(" AND "))
    assert len(read("2026-01-20").where("denominaci <> 'd24'").collect()) == 4 and Endpoint.where.startswith("(data_fi >= '2026-01-20T00:00:00.000' OR (data_fi IS NULL")


def test_event_images_take_missing_events_and_busy_answers(spark, endpoint):
    due = spark.createDataFrame([("a",), ("gone",), ("busy",), ("a",), (None,)], "event_id string")
    rows = readers.event_images(due, f"{endpoint}/event/{{id}}", partitions=2).collect()
    assert sorted((r["event_id"], r["url"], r["is_fallback"]) for r in rows) == [("a", "https://i/a", 0), ("busy", "https://i/busy", 0)]
    with pytest.raises(Exception, match="patience"):
        readers.event_images(due.where("event_id = 'a'").select(F.lit("slow").alias("event_id")), f"{endpoint}/event/{{id}}", patience=3).collect()


def test_search_by_index_equals_the_scan(spark, tmp_path):
    titles = ["Festa Major", "Concert de Jazz", "jazz", "El JAZZ-concert", "Fira", "", None, "ab", "Aplec a l'ermita", "Jazz\nnit"]
    rows = [{"title_ca": t, "original_title": t, "venue_name": "Teatre Àgora" if i % 3 == 0 else None, "municipality": "Sant Cugat" if i % 2 else "Vic", "province": "Girona / Est"} for i, t in enumerate(titles)]
    st = {n: spark.createDataFrame([], s) for n, s in TABLES.items()} | {"plans": plans(spark, *rows)}
    snapshot.write_snapshot(spark, st, str(tmp_path), index=True)
    index, stored = snapshot.read_index(spark, str(tmp_path)), snapshot.read_snapshot(spark, str(tmp_path))["plans"]
    ids = lambda df: sorted(r["id"] for r in df.select("id").collect())
    for q in ("jazz", "JÀZZ c", "a", "ab", "ra", "agora", "st", "zzz", "!", "major", "jazz nit", "t de j"):
        assert ids(index.search(q)) == ids(stored.where(predicates.text_search(q)))
        assert ids(search.matching(stored, search.Filters(q=q), NOW, index=index)) == ids(search.matching(stored, search.Filters(q=q), NOW))
    for q in ("vic", "sant cugat", "na / e", "x", "GIRONA"):
        assert ids(index.places(q)) == ids(stored.where(predicates.combobox(q)))
    plan = index.candidates("text", "major")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and re.search(r"PushedFilters: \[In\(gram|PushedFilters: \[.*gram", plan)


def test_an_upsert_leaves_other_buckets_alone(spark, tmp_path):
    st = {n: spark.createDataFrame([], s) for n, s in TABLES.items()}
    some = plans(spark, *({"title_ca": f"t{i}"} for i in range(40)))
    link = "id long, plan_id long, source_id long, source_record_id string, source_payload_json string"
    links = spark.createDataFrame([(i, i, 1, f"r{i}", "{}") for i in range(1, 41)], link)
    st |= {"plans": some, "plan_sources": st["plan_sources"].unionByName(links, allowMissingColumns=True), "categories": seeded_categories(spark)}
    store = BucketStore.create(spark, st, str(tmp_path), buckets=8)
    files = lambda: {str(p): (p.stat().st_mtime_ns, p.stat().st_size) for p in tmp_path.rglob("*.parquet")}
    before, paths = files(), {n: dict(p) for n, p in store.paths.items()}
    plan = {"fingerprint": "new", "status": "active", "quality_score": 50, "original_title": "New"}
    incoming = spark.createDataFrame([(1, "r7", "f7", '{"v":1}', "Changed", "active", 50, ["musica"]), (2, "r99", "new", "{}", "New", "active", 50, [])], "pos long, record_id string, fingerprint string, payload string, original_title string, status string, quality_score int, category_slugs array<string>")
    new, outcomes = store.upsert(incoming, 1, "2026-08-17")
    assert sorted((r["record_id"], r["outcome"], r["plan_id"]) for r in outcomes.collect()) == [("r7", "updated", 7), ("r99", "inserted", 41)]
    assert all(files()[f] == at for f, at in before.items())
    moved = {n: [b for b in new.paths[n] if new.paths[n][b] != paths[n].get(b)] for n in new.paths}
    assert len(moved["plans"]) <= 2 and len(moved["plan_sources"]) <= 2 and len(moved["plan_categories"]) <= 1 and not moved["images"] and not moved["categories"]
    full = state.apply_batch(st, state.upsert_outcomes(incoming, st["plan_sources"], st["plans"], 1), 1, "2026-08-17")
    got = new.read()
    for name in ("plans", "plan_sources", "plan_categories"):
        assert sorted(map(str, got[name].collect())) == sorted(map(str, full[name].select(*got[name].columns).collect()))
    assert plan and len(new.vacuum()) == 0
    again = BucketStore.create(spark, got, str(tmp_path), buckets=8)
    assert len(again.vacuum()) == 2 and again.read()["plans"].count() == 41


def test_feed_is_sniffed_and_capped(spark, tmp_path, monkeypatch):
    event = {"eventId": "e1", "eventName": "N", "venue": {"name": "V"}}
    (tmp_path / "packed.json").write_bytes(gzip.compress(json.dumps([event]).encode()))
    assert readers.read_feed(spark, str(tmp_path / "packed.json")).first()["event_id"] == "e1"
    (tmp_path / "plain.gz.json").write_text(json.dumps({"events": [event]}))
    assert readers.read_feed(spark, str(tmp_path / "plain.gz.json")).first()["venue_name"] == "V"
    (tmp_path / "bomb.gz").write_bytes(gzip.compress(b" " * (readers.MAX_INFLATED + 5)))
    with pytest.raises(ValueError, match="too large"):
        readers.read_feed(spark, str(tmp_path / "bomb.gz"))


def test_event_image_files_and_dataset_time(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"event_id": "e", "images": [{"url": "https://i/1", "width": 5, "attribution": ""}, {"url": "https://i/2", "fallback": True}]}))
    rows = readers.read_event_images(spark, str(tmp_path / "i.json")).collect()
    assert [(r["url"], r["width"], r["is_fallback"], r["attribution"]) for r in rows] == [("https://i/1", 5, 0, None), ("https://i/2", None, 1, None)]
    assert spark.range(1).select(readers.dataset_timestamp(F.lit(1755424800)).alias("t")).first()["t"] == "2025-08-17T10:00:00.000Z"
    cutoff = spark.createDataFrame([("a", "2026-01-02", None), ("b", None, "2026-01-02"), ("c", "2025-01-01", "2026-02-02"), ("d", None, None)], "codi string, data_fi string, data_inici string").withColumn("permanent", F.when(F.col("codi") == "d", "Sí"))
    assert sorted(r["codi"] for r in readers.current_agenda(cutoff, "2026-01-01").collect()) == ["a", "b", "d"]


def test_a_failed_snapshot_leaves_the_old_one(spark, tmp_path):
    empty = {n: spark.createDataFrame([], s) for n, s in TABLES.items()}
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        snapshot.read_snapshot(spark, root)
    snapshot.write_snapshot(spark, empty | {"categories": seeded_categories(spark)}, root)
    broken = empty | {"plans": spark.range(1).select(F.raise_error(F.lit("no")).cast("long").alias("id"))}
    with pytest.raises(Exception, match="no"):
        snapshot.write_snapshot(spark, broken, root)
    assert snapshot.read_snapshot(spark, root)["categories"].count() == 18


def test_versions_are_applied_once(spark):
    st, ledger = versions.migrate(spark, {"categories": spark.createDataFrame([(40, "natura", "x", "y", "g", "i")], TABLES["categories"])}, None, "t1")
    assert set(st) == set(TABLES) and [tuple(r) for r in ledger.orderBy("name").collect()] == [("001_relations", "t1"), ("002_categories", "t1")]
    rows = {r["slug"]: (r["id"], r["name_ca"]) for r in st["categories"].collect()}
    assert len(rows) == 18 and rows["natura"] == (40, "Natura") and len({i for i, _ in rows.values()}) == 18
    again, second = versions.migrate(spark, st, ledger, "t2")
    assert again is st and second.count() == 2


def test_settings():
    s = Settings.of({"PAGE_SIZE": "50x", "RETENTION_DAYS": "0", "INACTIVE_DAYS": "0", "LOOKAHEAD_DAYS": "-3", "IMAGES_ENABLED": "yes", "LANGUAGE": ""})
    assert (s.page_size, s.retention_days, s.inactive_days, s.lookahead_days, s.images_enabled, s.language) == (50, 0, 7, 90, False, "ca")


def test_unknown_dependencies_stop_a_purge(spark):
    st = {n: spark.createDataFrame([], s) for n, s in TABLES.items()}
    state.check_dependencies(st)
    with pytest.raises(ValueError, match="notes"):
        state.check_dependencies(st | {"notes": spark.createDataFrame([], "plan_id long")})
    with pytest.raises(ValueError, match="inactive_at"):
        state.check_dependencies(st | {"plans": st["plans"].drop("inactive_at")})


def test_labels_of_cards(spark):
    row = spark.sql("SELECT array(named_struct('slug', 'b'), named_struct('slug', 'a')) AS categories, 'event' AS kind, named_struct('url', 'u') AS image, true AS image_reuse_allowed, 'p' AS image_url, '2026-08-17T10' AS source_updated_at, '2020' AS imported_at, '2026-03-01' AS d")
    got = row.select(present.primary_category().alias("c"), present.shown_image().alias("i"), present.attribution_date().alias("a"), present.long_date(F.col("d"), "es").alias("d")).first()
    assert tuple(got) == ("b", "u", "2026-08-17", "1 de marzo de 2026")


def test_texts_are_joined_last(spark):
    """Nothing moves a document's text on to a further join, so the first join from the top is that of the documents."""
    plan = relation(spark, "/root/testdata/sf0.001", "plans")._jdf.queryExecution().optimizedPlan().toString()
    assert "doc_id" in next(line for line in plan.splitlines() if "Join" in line)


def test_an_index_has_a_repeated_line_once(spark, tmp_path):
    sizes = []
    for copies in (1, 50):
        some = plans(spark, *({"title_ca": "Festa Major", "original_title": "Festa Major", "venue_name": "Sala", "municipality": "Vic"} for _ in range(copies)))
        write_index(some, str(tmp_path / str(copies)))
        index = SearchIndex(spark, str(tmp_path / str(copies)))
        sizes.append(index.postings.count())
        assert sorted(r["id"] for r in index.search("festa").collect()) == sorted(r["id"] for r in index.places("vic").collect()) == list(range(1, copies + 1))
    assert sizes[0] == sizes[1]


def test_plans_of_a_document_lie_together(spark):
    """So a snapshot's files have a repeated text once."""
    rows = relation(spark, "/root/testdata/sf0.001", "plans").select("id", "original_description").collect()
    many = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    documents = [r["id"] % many for r in rows]
    assert 1 + sum(a != b for a, b in zip(documents, documents[1:])) == len(set(documents)) < len(rows)


def test_a_batch_without_texts_moves_none(spark, tmp_path):
    st = {n: spark.createDataFrame([], s) for n, s in TABLES.items()} | {"plans": plans(spark, *({"original_description": "long"} for _ in range(20)), {"title_ca": None, "original_title": None})}
    store = BucketStore.create(spark, st, str(tmp_path), buckets=4)
    before = {n: dict(p) for n, p in store.paths.items()}
    rows = [(1, "r1", "f7", "{}", "active", 90, []), (2, "r2", "new", "{}", "active", 50, [])]
    new, _ = store.upsert(spark.createDataFrame(rows, "pos long, record_id string, fingerprint string, payload string, status string, quality_score int, category_slugs array<string>"), 1, "2026-08-17")
    assert new.paths["texts"] == before["texts"] and new.paths["plans"] != before["plans"]
    got = {r["id"]: (r["title_ca"], r["original_description"], r["quality_score"]) for r in new.read()["plans"].collect()}
    assert got == {i: (f"t{i}", "long", 90 if i == 7 else 80) for i in range(1, 21)} | {21: (None, None, 80), 22: (None, None, 50)}


def test_a_long_text_is_stored_once(spark, tmp_path):
    long, title, other = "long " * 40, "t" * 65, "other " * 40
    given = [{"original_description": long, "description_es": long, "title_ca": title if i % 2 else "t" * 64} for i in range(30)]
    st = {n: spark.createDataFrame([], s) for n, s in TABLES.items()} | {"plans": plans(spark, *given, {"original_description": None, "title_ca": ""})}
    store = BucketStore.create(spark, st, str(tmp_path), buckets=4)
    bodies = lambda s: sorted(r["body"] for r in s._rows("bodies", None).collect())
    before = dict(store.paths["bodies"])
    assert bodies(store) == [long, title]
    held = lambda df: sorted(map(str, df.collect()))
    assert held(store.read()["plans"]) == held(st["plans"].select(*store.read()["plans"].columns))
    rows = [(1, "r1", "f7", "{}", "active", 90, [], other, title), (2, "r2", "new", "{}", "active", 50, [], None, long)]
    batch = spark.createDataFrame(rows, "pos long, record_id string, fingerprint string, payload string, status string, quality_score int, category_slugs array<string>, title_es string, original_title string")
    new, outcomes = store.upsert(batch, 1, "2026-08-17")
    assert bodies(new) == [long, other, title] and new.paths["bodies"] != before
    full = state.apply_batch(st, outcomes, 1, "2026-08-17")["plans"]
    assert held(new.read()["plans"]) == held(full.select(*new.read()["plans"].columns))
    assert new.read(texts=False)["plans"].count() == 32 and "title_ca" not in new.read(texts=False)["plans"].columns
