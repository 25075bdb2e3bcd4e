"""An inverted index of character trigrams over the texts that searches look into.

Postings (bucket, gram, line) are sorted, so a search reads the few files and row groups that can hold the query's grams;
the folded lines that have all of them are checked, and their plans looked up.  The texts of plans are
neither read nor folded.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import key, python_key
from ..operators import predicates as P

#: Length of a gram, and folders by its first character.
GRAM, BUCKETS = 3, 32
#: What follows the end of a line, so that its last characters begin grams too.
PAD = "\x01" * (GRAM - 1)


@F.pandas_udf(ArrayType(StringType()))
def _grams(texts: pd.Series) -> pd.Series:
    def of(text: str) -> list[str]:
        return sorted({line[i : i + GRAM] for line in (t + PAD for t in text.split("\n")) for i in range(len(line) - GRAM + 1)})

    return texts.map(of)


def write_index(plans: DataFrame, path: str) -> None:
    """The index of ``plans`` in a new folder: field text (titles and venue, as keys) and field place.

    A line is stored once, however many plans have it; ``owners`` says which.  Moving what the plans' rows repeat is thus
    left out: of a plan only its id and its lines' hashes move.
    """
    fields = {"text": [key(F.col(n)) for n in ("original_title", "title_ca", "title_es", "venue_name")], "place": [F.coalesce(P.place_text(), F.lit(""))]}
    each = F.array(*(F.struct(F.lit(n).alias("field"), c.alias("text")) for n, columns in fields.items() for c in columns))
    pairs = plans.select("id", F.explode(F.array_distinct(each)).alias("f")).select("id", "f.field", "f.text").withColumn("line", F.unhex(F.md5("text")))
    pairs.select("field", "text", "line").distinct().repartitionByRange("field", "line").sortWithinPartitions("field", "line").write.partitionBy("field").parquet(f"{path}/lines")
    pairs.select("field", "line", "id").repartitionByRange("field", "line", "id").sortWithinPartitions("field", "line", "id").write.partitionBy("field").parquet(f"{path}/owners")
    stored = plans.sparkSession.read.schema("line binary, text string, field string").parquet(f"{path}/lines")
    grams = stored.select("field", "line", F.explode(_grams("text")).alias("gram")).withColumn("bucket", F.ascii("gram") % BUCKETS)
    grams.repartitionByRange("field", "bucket", "gram", "line").sortWithinPartitions("field", "bucket", "gram", "line").write.partitionBy("field", "bucket").parquet(f"{path}/postings")


class SearchIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.lines = spark.read.schema("line binary, text string, field string").parquet(f"{path}/lines")
        self.owners = spark.read.schema("line binary, id long, field string").parquet(f"{path}/owners")
        self.postings = spark.read.schema("line binary, gram string, field string, bucket int").parquet(f"{path}/postings")

    def candidates(self, field: str, needle: str) -> DataFrame:
        """(line) of what has all grams of a folded query; of a query shorter than a gram, what has a gram that begins with it."""
        rows = self.postings.where(F.col("field") == field)
        if len(needle) < GRAM:
            return rows.where((F.col("bucket") == ord(needle[0]) % BUCKETS) & F.col("gram").startswith(needle)).select("line").distinct()
        grams = sorted({needle[i : i + GRAM] for i in range(len(needle) - GRAM + 1)})
        rows = rows.where(F.col("bucket").isin(sorted({ord(g[0]) % BUCKETS for g in grams})) & F.col("gram").isin(grams))
        return rows.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("line")

    def ids(self, field: str, needle: str) -> DataFrame:
        """(id) of what has the folded query in one line of the field's text; an empty query finds all."""
        mine = self.owners.where(F.col("field") == field)
        if needle:
            found = self.lines.where(F.col("field") == field).join(self.candidates(field, needle), "line", "left_semi").where(F.col("text").contains(needle))
            mine = mine.join(found, "line", "left_semi")
        return mine.select("id").distinct()

    def search(self, q: str) -> DataFrame:
        """The ids that ``predicates.text_search`` finds."""
        return self.ids("text", python_key(q))

    def places(self, query: str, aliases: dict[str, str] | None = None) -> DataFrame:
        """The ids that ``predicates.combobox`` finds."""
        return self.ids("place", P.place_query(query, aliases))
