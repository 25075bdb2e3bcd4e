"""Text functions as native column expressions."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Articles that title keys leave out.
ARTICLES = ["el", "els", "la", "les", "l", "un", "uns", "una", "unes", "de", "del", "dels", "d", "al", "als"]
# Particles that names keep in lower case, unless they come first.
PARTICLES = ["de", "del", "dels", "i", "la", "les"]
# Words for yes and no, after folding.
YES, NO = ["si", "yes", "true", "1"], ["no", "false", "0"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@lru_cache(1)
def _folding() -> tuple[str, str]:
    """Characters whose canonical decomposition begins with an ASCII letter or digit, and these."""
    pairs = []
    for code in range(0x80, 0x30000):
        if 0xD800 <= code < 0xE000:
            continue
        first = unicodedata.normalize("NFD", chr(code))[0]
        if first.isascii() and first.isalnum():
            pairs.append((chr(code), first))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(c: Column) -> Column:
    """Lower case without accents and combining marks."""
    return F.lower(F.regexp_replace(F.translate(c, *_folding()), "[\\u0300-\\u036f]", ""))


def key(c: Column, separator: str = "-") -> Column:
    """Folded runs of letters and digits, joined by the separator; '' for null."""
    joined = F.regexp_replace(fold(c), "[^a-z0-9]+", separator)
    return F.coalesce(F.regexp_replace(joined, f"^{separator}|{separator}$", ""), F.lit(""))


def title_key(c: Column) -> Column:
    """``key`` without articles."""
    return F.array_join(F.filter(F.split(key(c), "-"), lambda x: ~x.isin(ARTICLES)), "-")


def python_key(value: str | None) -> str:
    """``key`` of a query parameter, computed once on the driver."""
    table = str.maketrans(*_folding())
    folded = "".join(c for c in (value or "").translate(table) if not 0x300 <= ord(c) <= 0x36F).lower()
    return "-".join("".join(c if c.isascii() and c.isalnum() else " " for c in folded).split())


def nocase(c: Column) -> Column:
    """ASCII letters in lower case, all others as they are."""
    return F.translate(c, _UPPER, _LOWER)


def filled(c: Column) -> Column:
    """Null instead of a string without anything but white space; else the string, untrimmed."""
    return F.when(c.rlike(r"(?U)\S"), c)


def nonempty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_nonempty(*columns: Column) -> Column:
    return F.coalesce(*(nonempty(c) for c in columns))


def iso_prefix(c: Column) -> Column:
    """A leading date as text, else null."""
    return nonempty(F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2})", 1))


def yes_no(c: Column) -> Column:
    """1, 0 or null for the words of yes and no."""
    return computed(F.trim(fold(c)), lambda folded: F.when(folded.isin(YES), 1).when(folded.isin(NO), 0))


def coordinate(c: Column, low: float, high: float) -> Column:
    """A number within bounds; only plain decimal notation counts."""
    number = F.when(F.trim(c).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.trim(c).try_cast("double"))
    return F.when(number.between(low, high), number)


def computed(c: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def strip_html(c: Column) -> Column:
    """Text without tags; the references that occur in feeds are decoded, white space folded; null if blank."""
    steps = [
        (r"(?i)<br\s*/?>|</p>", " "), (r"<[^>]*>", " "), (r"(?i)&nbsp;|&#160;", " "), (r"(?i)&amp;", "&"),
        (r"(?i)&quot;", '"'), (r"(?i)&#39;|&apos;", "'"), (r"(?i)&lt;", "<"), (r"(?i)&gt;", ">"),
    ]
    for pattern, new in steps:
        c = F.regexp_replace(c, pattern, new)
    return nonempty(F.regexp_replace(F.regexp_replace(computed(c, _decimal_references), r"(?U)\s+", " "), "^ | $", ""))


def _decimal_references(c: Column) -> Column:
    """&#N; decoded; text without one is left alone."""
    codes = F.regexp_extract_all(c, F.lit(r"&#(\d+);"), F.lit(1))
    gaps = F.split(c, r"&#\d+;")
    pieces = F.zip_with(gaps, F.transform(codes, _character), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
    return F.when(c.rlike(r"&#\d+;"), F.array_join(pieces, "")).otherwise(c)


def _character(code: Column) -> Column:
    """A code point as text: its UTF-32 bytes, decoded; null for what is none, see ``html_fault``."""
    number = code.try_cast("bigint")
    return F.decode(F.unhex(F.lpad(F.hex(F.when(_is_character(number), number)), 8, "0")), "UTF-32")


def _is_character(number: Column) -> Column:
    return F.coalesce(number.between(0, 0x10FFFF) & ~number.between(0xD800, 0xDFFF), F.lit(False))


def html_fault(*columns: Column) -> Column:
    """Why a text can't be decoded: a reference to a number that is no character; null if there is none."""
    codes = F.regexp_extract_all(F.regexp_replace(F.concat_ws(" ", *columns), "(?i)&amp;", "&"), F.lit(r"&#(\d+);"), F.lit(1))
    wrong = F.filter(codes, lambda x: ~_is_character(x.try_cast("bigint")))
    return F.when(F.size(wrong) > 0, F.concat(F.lit("no such character: "), F.substring(F.element_at(wrong, 1), 1, 40)))


def humanize(slug: Column) -> Column:
    """A slug as a name: words capitalised but for particles, D and L elided before a vowel or H."""
    return computed(slug, _named)


def _named(slug: Column) -> Column:
    words = F.split(F.coalesce(F.try_url_decode(slug), slug), "-")
    named = F.transform(words, lambda w, i: F.when((i > 0) & w.isin(PARTICLES), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))))
    return nonempty(F.regexp_replace(F.array_join(named, " "), r"\b([DL]) (?=[AEIOUH])", "$1'"))


def location_tag(c: Column) -> Column:
    """Province, comarca and municipality from the path after the marker of a location tag."""
    path = F.split(F.when(c.contains("agenda:ubicacions/"), F.substring_index(c, "agenda:ubicacions/", -1)), "/")
    return F.struct(*(humanize(nonempty(F.try_element_at(path, F.lit(i + 1)))).alias(n) for i, n in enumerate(("province", "comarca", "municipality"))))


def xml_escape(c: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def compact(c: Column, limit: int = 160) -> Column:
    """White space folded; a longer text is cut at the last space before the limit and gets an ellipsis."""
    line = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(line) <= limit, line).otherwise(F.concat(F.regexp_replace(F.substring(line, 1, limit), r" [^ ]*$", ""), F.lit("…")))


def canonical_json(c: Column) -> Column:
    """JSON text with sorted keys and without white space."""
    return F.to_json(F.try_parse_json(c))


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+')


def cut_keys(text: str, keys: frozenset[str]) -> str:
    """JSON text without members of these names, however deep; all other values stay as they are written."""
    out, open_ = [], []  # of each open object or array: whether it is an object, and whether it has a member yet
    depth, key, skip = 0, None, False
    for found in _TOKEN.finditer(text):
        token = found[0]
        if skip:
            depth += (token in "{[") - (token in "}]")
            if depth > 0 or (depth == 0 and token != ","):
                continue
            skip = False
        if token in "}]":
            out.append(token)
            open_.pop()
        elif token == ",":
            key = None
        elif token != ":":
            if open_ and open_[-1][0] and key is None:
                key = json.loads(token)
                if key in keys:
                    skip, depth, key = True, 0, None
                    continue
                out.append(("," if open_[-1][1] else "") + token + ":")
                open_[-1][1] = True
                continue
            if open_ and not open_[-1][0]:
                out.append("," if open_[-1][1] else "")
                open_[-1][1] = True
            out.append(token)
            if token in "{[":
                open_.append([token == "{", False])
                key = None
    return "".join(out)


def without_keys(c: Column, keys: tuple[str, ...]) -> Column:
    """``canonical_json`` without members of these names at any depth; only text that has such a name goes to Python."""
    names = frozenset(keys)

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else cut_keys(t, names))

    whole = canonical_json(c)
    marked = whole.rlike('"(?:' + "|".join(map(re.escape, keys)) + ')":')
    return F.when(marked, cut(F.when(marked, whole))).otherwise(whole)


def safe_url(c: Column) -> Column:
    """The URL if it is one of http or https, else null."""
    return F.when(F.lower(F.try_parse_url(F.trim(c), F.lit("PROTOCOL"))).isin("http", "https"), F.trim(c))
