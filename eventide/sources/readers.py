"""Readers of records and of the stored catalogue."""

from __future__ import annotations

import json
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringStartsWith,
)

from ..functions.text import first_nonempty
from ..plans.schemas import AGENDA, AGENDA_FIELDS, TABLES

PAGE_SIZE = 1000
MAX_COMPRESSED, MAX_INFLATED = 25 << 20, 150 << 20
#: Seconds that an answer can ask to wait, at most.
MAX_WAIT = 10.0


def read_agenda(spark: SparkSession, path: str) -> DataFrame:
    """Agenda records from JSON files, all fields as text; missing ones are null."""
    return spark.read.schema(AGENDA).json(path, multiLine=True)


def current_agenda(records: DataFrame, cutoff: str) -> DataFrame:
    """What an import asks the source for: not over by the cutoff, undated ends by their start, or permanent."""
    end, start = F.col("data_fi"), F.col("data_inici")
    return records.where((end >= cutoff) | (end.isNull() & (start >= cutoff)) | (F.lower("permanent").isin("si", "sí")))


def dataset_timestamp(seconds) -> object:
    """Unix seconds of a dataset's last change as an ISO instant."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _inflated(batches):
    """(content) of whole files to (value, large): text, unpacked if the first bytes say gzip, or that it is too large."""
    import zlib

    import pyarrow as pa

    for batch in batches:
        values, large = [], []
        for content in batch.column(0).to_pylist():
            packed = content[:2] == b"\x1f\x8b"
            too_large = len(content) > (MAX_COMPRESSED if packed else MAX_INFLATED)
            if packed and not too_large:
                content = zlib.decompressobj(31).decompress(content, MAX_INFLATED + 1)
                too_large = len(content) > MAX_INFLATED
            large.append(too_large)
            values.append(None if too_large else content.decode("utf-8", "replace").strip())
        yield pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array(large, pa.bool_())], ["value", "large"])


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """A complete feed, JSON or gzip by its first bytes: an array or an object with ``events``; see ``flatten_feed``.

    Too large files, packed or unpacked, and empty or foreign members fail the read.
    """
    text = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_inflated, "value string, large boolean")
    if text.where("large").head(1):
        raise ValueError("the feed is too large")
    members = F.when(F.col("value").startswith("["), F.col("value")).otherwise(F.get_json_object("value", "$.events"))
    events = text.select(F.from_json(members, "array<variant>", {"mode": "FAILFAST"}).alias("events")).select(F.posexplode("events").alias("pos", "record"))
    foreign = ~F.coalesce(F.to_json("record").startswith("{"), F.lit(False))
    if not events.head(1) or events.where(foreign).head(1):
        raise ValueError("the feed is empty or has members that are no events")
    return flatten_feed(events)


# The fields of a record that tell its classification.
CLASSES = ("classificationSegment", "classificationGenre", "classificationSubGenre", "classificationType", "classificationSubType", "segmentName", "genreName", "subGenreName", "classification")


def flatten_feed(records: DataFrame) -> DataFrame:
    """(pos, record), records being variants, with the first defined of each field's aliases under the names that the feed operators use.

    A record keeps all that it has; fields of other kinds than expected are read as text, or are null; coordinates that are no numbers are not-a-number.
    """
    get = lambda name, kind="string": F.try_variant_get("record", f"$.{name}", kind)
    first = lambda *names: F.coalesce(*(get(n) for n in names))
    venue = lambda *names: first(*(f"venue.{n}" for n in names))
    #: Only what is a string in the record counts as text there.
    string = lambda name: F.when(F.to_json(get(name, "variant")).startswith('"'), get(name))
    members = lambda name: F.coalesce(F.array_join(F.map_values(get(name, "map<string, string>")), " "), F.array_join(get(name, "array<string>"), " "), get(name))
    number = lambda c: F.when(F.trim(c) != "", F.coalesce(F.trim(c).try_cast("double"), F.lit(float("nan"))))
    country = first_nonempty(venue("countryCode", "venueCountryCode"), get("countryCode"))
    return records.select(
        "pos", "record", get("eventId").alias("event_id"), get("eventName").alias("title"), get("source").alias("source"), get("brandName").alias("brand_name"),
        (F.to_json(get("officialSeller", "variant")) == "true").alias("official_seller"), get("eventStartLocalDate").alias("start_date"), first("eventEndLocalDate", "eventStartLocalDate").alias("end_date"),
        get("eventStartLocalTime").alias("start_time"), get("primaryEventUrl").alias("url"), F.concat_ws(" ", *(members(n) for n in CLASSES)).alias("classes"), string("eventInfo").alias("info"),
        first_nonempty(string("priceRange"), string("priceRanges")).alias("price"), get("eventStatus").alias("event_status"), venue("venueId").alias("venue_id"), venue("venueName", "name").alias("venue_name"),
        country.alias("country"), venue("state", "stateName", "venueState", "venueStateCode", "province").alias("state"), venue("city", "cityName", "venueCity").alias("municipality"),
        venue("postalCode", "venuePostalCode", "venueZipCode").alias("postal_code"), F.coalesce(get("venue.address.line1"), string("venue.address"), venue("addressLine1", "venueStreet")).alias("address"),
        number(venue("latitude", "lat", "venueLatitude")).alias("latitude"), number(venue("longitude", "lon", "lng", "venueLongitude")).alias("longitude"),
    )


def read_event_images(spark: SparkSession, path: str) -> DataFrame:
    """(event_id, url, ratio, width, height, is_fallback, attribution) from JSON lines of an event's image list."""
    schema = "event_id string, images array<struct<url: string, ratio: string, width: int, height: int, fallback: boolean, attribution: string>>"
    rows = spark.read.schema(schema).json(path).select("event_id", F.explode("images").alias("i"))
    return rows.select("event_id", "i.url", "i.ratio", "i.width", "i.height", F.coalesce("i.fallback", F.lit(False)).cast("int").alias("is_fallback"), first_nonempty(F.col("i.attribution")).alias("attribution"))


def read_catalogue(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The relations of a snapshot."""
    return {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in TABLES.items()}


class Patience:
    """Seconds that waits may take together; what would go beyond fails."""

    def __init__(self, seconds: float = float("inf")):
        self.left = seconds

    def wait(self, seconds: float) -> None:
        import time

        if seconds > self.left:
            raise TimeoutError("the source asks for more patience than there is left")
        self.left -= seconds
        time.sleep(seconds)


def fetched(url: str, tries: int, timeout: int, missing: object = None, patience: Patience | None = None):
    """The JSON at a URL; ``missing`` for 404.  429 waits as the answer says, ten seconds at most, and counts as a try."""
    from urllib.error import HTTPError
    from urllib.request import urlopen

    for turn in range(tries):
        wait = 0.0
        try:
            with urlopen(url, timeout=timeout) as answer:
                return json.load(answer)
        except HTTPError as e:
            if e.code == 404 and missing is not None:
                return missing
            if turn + 1 == tries:
                raise
            if e.code == 429:
                asked = e.headers.get("retry-after") or "1"
                wait = min(float(asked) if asked.isdigit() else 1.0, MAX_WAIT)
        except OSError:
            if turn + 1 == tries:
                raise
        (patience or Patience()).wait(wait)
    return missing


class _Page(InputPartition):
    def __init__(self, offset: int, last: bool):
        self.offset, self.last = offset, last


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.rows, self.size = options["url"], int(options.get("rows", 0)), int(options.get("pagesize", PAGE_SIZE))
        self.order, self.where, self.tries = options.get("order", "codi"), options.get("where", ""), int(options.get("tries", 3))
        self.metadata, self.dataset = options.get("metadata"), options.get("dataset")

    def partitions(self):
        if self.metadata:
            found = fetched(self.metadata, self.tries, 30)
            if not isinstance(found, dict) or found.get("id") != self.dataset or not isinstance(found.get("columns"), list):
                raise ValueError("the metadata is not that of the dataset")
        starts = range(0, max(1, self.rows), self.size)
        return [_Page(i, i == starts[-1]) for i in starts]

    def read(self, partition: _Page):
        """A page; the last one goes on until a page is not full, so that new rows are not missed."""
        from urllib.parse import urlencode

        offset, more = partition.offset, True
        while more:
            query = {"$limit": self.size, "$offset": offset, "$order": self.order} | ({"$where": self.where} if self.where else {})
            records = fetched(f"{self.url}?{urlencode(query)}", self.tries, 30)
            for r in records:
                yield tuple(None if r.get(f) is None else str(r[f]) for f in AGENDA_FIELDS)
            offset, more = offset + self.size, partition.last and len(records) == self.size


#: Fields whose values compare as text at the endpoint too.
_TEXTS = frozenset(AGENDA_FIELDS) - {"latitud", "longitud"}


def _quoted(value: object) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def soql(condition: Filter) -> str | None:
    """A Spark predicate in the endpoint's language, null if it has no such form."""
    if isinstance(condition, Not):
        inner = soql(condition.child)
        return inner and f"NOT ({inner})"
    (name, *deeper), value = condition.attribute, getattr(condition, "value", None)
    if deeper or name not in _TEXTS:
        return None
    signs = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
    if type(condition) in signs and isinstance(value, str):
        return f"{name} {signs[type(condition)]} {_quoted(value)}"
    if isinstance(condition, In) and condition.value and all(isinstance(v, str) for v in condition.value):
        return f"{name} IN ({', '.join(map(_quoted, condition.value))})"
    if isinstance(condition, StringStartsWith):
        return f"starts_with({name}, {_quoted(value)})"
    return {IsNull: f"{name} IS NULL", IsNotNull: f"{name} IS NOT NULL"}.get(type(condition))


class _PushingReader(_PagedReader):
    def pushFilters(self, filters):
        """All that the endpoint can take narrows its ``$where``; Spark looks at every filter again, as texts may compare otherwise there."""
        found = [c for c in map(soql, filters) if c]
        self.where = " AND ".join(f"({c})" for c in [self.where, *found] if c)
        yield from filters


def current_where(cutoff: str) -> str:
    """``current_agenda`` in the endpoint's language; Spark hands on no disjunctions, so it is given as an option."""
    at = _quoted(f"{cutoff}T00:00:00.000")
    return f"data_fi >= {at} OR (data_fi IS NULL AND data_inici >= {at}) OR permanent = 'Sí'"


def agenda_pages(spark: SparkSession, url: str, cutoff: str | None = None, **options) -> DataFrame:
    """The records at a paged endpoint, whose own filter gets what an import wants and what the query asks for besides."""
    spark.dataSource.register(PagedAgenda)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    where = {"where": current_where(cutoff)} if cutoff else {}
    return spark.read.format("paged_agenda").options(url=url, pushdown="true", **where, **options).load()


class PagedAgenda(DataSource):
    """A paged open-data endpoint, one partition for each page: options url, rows (as known), pageSize, order, where, metadata and dataset.

    With pushdown = true (which needs the session's setting for it, see ``agenda_pages``), filters go to the endpoint.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_agenda"

    def schema(self) -> str:
        return AGENDA

    def reader(self, schema) -> _PagedReader:
        options = dict(self.options)
        return _PushingReader(options) if options.get("pushdown") == "true" else _PagedReader(options)


IMAGES = "event_id string, url string, ratio string, width int, height int, is_fallback int, attribution string"


def event_images(due: DataFrame, url: str, partitions: int = 64, tries: int = 3, patience: float = 120.0) -> DataFrame:
    """The image lists at ``url`` (with {id}) of the events in ``due`` (event_id): a table function over its partitions.

    Unknown events have none.  The events of a partition are asked for one after another, and wait ``patience`` seconds
    together at most; ids never pass the driver.
    """

    @F.udtf(returnType=IMAGES)
    class Fetch:
        def __init__(self):
            self.patience = Patience(patience)

        def eval(self, row):
            event_id = row["event_id"]
            found = fetched(url.replace("{id}", quote(event_id, safe="")), tries, 15, {}, self.patience)
            for i in (found if isinstance(found, list) else found.get("images") or []):
                yield event_id, i.get("url"), i.get("ratio"), i.get("width"), i.get("height"), int(bool(i.get("fallback"))), i.get("attribution") or None

    ids = due.select(F.col("event_id").cast("string").alias("event_id")).where("event_id IS NOT NULL").distinct()
    spread = ids.withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(partitions)))
    return Fetch(spread.asTable().partitionBy("part"))
