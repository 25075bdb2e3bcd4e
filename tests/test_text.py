import unicodedata

import pytest
from pyspark.sql import functions as F

from eventide.functions import text as X


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "s string").select(f(F.col("s")).alias("x")).first()["x"]


def model(value):
    s = "".join(c for c in unicodedata.normalize("NFD", value or "") if not 0x300 <= ord(c) <= 0x36F).lower()
    return "-".join("".join(c if c.isascii() and c.isalnum() else " " for c in s).split())


@pytest.mark.parametrize("value", [None, "", "Concert d’Estiu", "L'Empordà – l·l", "ÀÉÎõü ñ Ç", "ﬁ ß K Å ǆ", "  a--b  ", "日本 x"])
def test_key(spark, value):
    assert one(spark, value, X.key) == model(value) == X.python_key(value)


def test_key_of_all_low_characters(spark):
    chars = [(f"a{chr(c)}b",) for c in range(0x20, 0x3000)]
    rows = spark.createDataFrame(chars, "s string").select("s", X.key(F.col("s")).alias("k")).collect()
    assert [r["s"] for r in rows if r["k"] != model(r["s"])] == []


def test_title_key_drops_articles(spark):
    assert one(spark, "El Concert de la Plaça", X.title_key) == "concert-placa"


def test_nocase_is_ascii_only(spark):
    assert one(spark, "ÀB", X.nocase) == "Àb"


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        (None, None), ("  ", None), ("<p>a<br/>b</p>c", "a b c"), ("x&nbsp;&amp;lt;y", "x <y"), ("&#65;&#8364;!", "A€!"), ("<b>a  b</b>", "a b"), ("&#128512;", "😀"), ("no refs", "no refs"),
    ],
)
def test_strip_html(spark, value, expected):
    assert one(spark, value, X.strip_html) == expected


@pytest.mark.parametrize(("value", "expected"), [("Sí", 1), (" TRUE ", 1), ("No", 0), ("0", 0), ("maybe", None), (None, None)])
def test_yes_no(spark, value, expected):
    assert one(spark, value, X.yes_no) == expected


@pytest.mark.parametrize(("value", "expected"), [("41.5", 41.5), ("91", None), ("1d", None), ("NaN", None), ("", None), (" 2 ", 2.0), (None, None)])
def test_coordinate(spark, value, expected):
    assert one(spark, value, lambda c: X.coordinate(c, -90, 90)) == expected


@pytest.mark.parametrize(("value", "expected"), [("baix-emporda", "Baix Emporda"), ("sant-feliu-de-guixols", "Sant Feliu de Guixols"), ("l-escala", "L'Escala"), ("la-garriga", "La Garriga"), (None, None)])
def test_humanize(spark, value, expected):
    assert one(spark, value, X.humanize) == expected


def test_location_tag(spark):
    got = one(spark, "agenda:ubicacions/girona/baix-emporda/palafrugell", X.location_tag)
    assert tuple(got) == ("Girona", "Baix Emporda", "Palafrugell")
    assert tuple(one(spark, "other", X.location_tag)) == (None, None, None)


def test_canonical_json_sorts_keys(spark):
    assert one(spark, '{"b": 1, "a": {"d": "x", "c": [1, 2]}}', X.canonical_json) == '{"a":{"c":[1,2],"d":"x"},"b":1}'
    assert one(spark, "no json", X.canonical_json) is None


def test_compact_and_escape(spark):
    assert one(spark, "aa  bb cc", lambda c: X.compact(c, 6)) == "aa bb…"
    assert one(spark, "aa  bb", X.compact) == "aa bb"
    assert one(spark, "<a&'\">", X.xml_escape) == "&lt;a&amp;&apos;&quot;&gt;"
    assert one(spark, "javascript:x", X.safe_url) is None
    assert one(spark, "https://a.example/x", X.safe_url) == "https://a.example/x"
