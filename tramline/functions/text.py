"""Parsing of the text fields of mobility sources as Column expressions."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: how an activity gives its start and end.
TIMES = r"Start Time: (\d+):(\d+):(\d+(?:\.\d+)?), End Time: (\d+):(\d+):(\d+(?:\.\d+)?)"
_NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"
DAY = 86400

# Age bands and the codes of people's attributes.
AGE_BANDS = [(0, 15, "0-15"), (16, 24, "16-24"), (25, 44, "25-44"), (45, 64, "45-64"), (65, 200, "65+")]
SEXES = {"Kvinnor": "Women", "Män": "Men"}
STATUSES = {"WORK": "Working", "EDUCATION": "Studying", "HOME": "At home"}


def activity_times(text: Column) -> tuple[Column, Column]:
    """Seconds of start and end; null without a match. An end before the start is on the next day."""
    part = [F.nullif(F.regexp_extract(text, TIMES, i), F.lit("")).try_cast("double") for i in range(1, 7)]
    start = part[0] * 3600 + part[1] * 60 + part[2]
    end = part[3] * 3600 + part[4] * 60 + part[5]
    return start, F.when(end < start, end + DAY).otherwise(end)


def wkt_coordinates(text: Column) -> tuple[Column, Column]:
    """x and y arrays of a WKT line; null for "None" or fewer than two points; an odd last number is dropped."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(f"({_NUMBER})"), F.lit(1)), lambda s: s.cast("double"))
    whole = F.slice(numbers, 1, (F.size(numbers) - F.size(numbers) % 2))
    usable = F.size(numbers) >= 4
    x = F.when(usable, F.filter(whole, lambda v, i: i % 2 == 0))
    return x, F.when(usable, F.filter(whole, lambda v, i: i % 2 == 1))


def route_or_straight(points: Column, origin: tuple[Column, Column], destination: tuple[Column, Column]) -> Column:
    """The points of a route, or without one those of the straight line from origin to destination; null if that fails too."""
    ends = [F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in (origin, destination)]
    known = F.lit(True)
    for c in (*origin, *destination):
        known = known & c.isNotNull()
    return F.coalesce(points, F.when(known, F.array(*ends)))


def wkt_point(text: Column) -> tuple[Column, Column]:
    """x and y of a WKT point; null if it has no two numbers."""
    pattern = rf"\(\s*({_NUMBER})\s+({_NUMBER})"
    x, y = (F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).cast("double") for i in (1, 2))
    return x, y


def vertex_count(text: Column) -> Column:
    """Vertices of a WKT line, by its commas."""
    return F.length(text) - F.length(F.replace(text, F.lit(","), F.lit(""))) + 1


def age_band(group: Column, age: Column) -> Column:
    """The band of the number that an age group begins with, or else of the age; "Unknown" without either."""
    years = F.coalesce(F.nullif(F.regexp_extract(group, r"^\s*(\d+)", 1), F.lit("")).try_cast("int"), age.cast("int"))
    band = F.lit("Unknown")
    for low, high, name in reversed(AGE_BANDS):
        band = F.when(years.between(low, high), name).otherwise(band)
    return band


def mapped(value: Column, names: dict[str, str], default: str) -> Column:
    """names[value], or the default."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.coalesce(value, F.lit(""))), F.lit(default))


def folded(value: Column, vocabulary: list[str], other: str = "Other") -> Column:
    """The value if the vocabulary has it, or else the fallback."""
    return F.when(value.isin(vocabulary), value).otherwise(F.lit(other))


def first_of(values: Column) -> Column:
    """The first element of an array; null if it is empty or null."""
    return F.try_element_at(values, F.lit(1))


def distinct_join(values: Column, separator: str = " | ") -> Column:
    """Distinct elements in order of first appearance, joined."""
    return F.array_join(F.array_distinct(values), separator)


def number(text: Column) -> Column:
    """A number, or null."""
    return text.try_cast("double")


def first_number(text: Column) -> Column:
    """The first number in a tag's text ("3;2": 3, "3.5 m": 3.5); null without one."""
    return F.nullif(F.regexp_extract(text, r"\d+(?:\.\d+)?", 0), F.lit("")).cast("double")


def any_tag(tags: Column, prefix: str, but: tuple[str, ...] = ("no", "none", "separate")) -> Column:
    """Whether a map of tags has a key with the prefix whose value isn't a refusal."""
    return F.coalesce(F.exists(F.map_entries(tags), lambda e: F.startswith(e["key"], F.lit(prefix)) & ~e["value"].isin(*but)), F.lit(False))


def tag_is(tags: Column, key: str, value: str) -> Column:
    return F.coalesce(F.try_element_at(tags, F.lit(key)) == value, F.lit(False))


def street_name(name: Column) -> Column:
    """The name without outer white space; empty for null."""
    return F.trim(F.coalesce(name, F.lit("")))


def allowed(kind: Column, excluded: list[str]) -> Column:
    """Whether a class isn't excluded; an unknown class is allowed."""
    return F.coalesce(~kind.isin(excluded), F.lit(True))


def road_number(main: Column, sub: Column, european: Column) -> Column:
    """"E6", "155" or "155.2" from the parts of a road number."""
    joined = F.when(sub.isNotNull() & (sub != 0), F.concat_ws(".", main.cast("string"), sub.cast("string"))).otherwise(main.cast("string"))
    return F.when(main.isNull(), F.lit(None)).when(F.coalesce(european, F.lit(False)), F.concat(F.lit("E"), joined)).otherwise(joined)


def html_escape(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def url_parameters(text: Column) -> Column:
    """The parameters after "?" or "#" of an address as a map."""
    after = F.regexp_extract(text, r"[?#]([^#]*)", 1)
    pairs = F.filter(F.split(after, "&"), lambda p: F.contains(p, F.lit("=")))
    entries = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.regexp_replace(p, "^[^=]*=", "").alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def clock(minutes: Column) -> Column:
    """"HH:MM" of minutes since midnight, around the day."""
    m = F.pmod(F.floor(minutes).cast("int"), F.lit(1440))
    return F.concat(F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"))


def date_of(yyyymmdd: Column) -> Column:
    """The date of a number such as 20190331; null if there is none."""
    return F.try_to_timestamp(yyyymmdd.cast("string"), F.lit("yyyyMMdd")).cast("date")


#: The byte of each character that Windows-1252 has beyond ASCII, and the other way round.
_BYTE_OF = {bytes([b]).decode("cp1252"): b for b in range(128, 256) if bytes([b]).decode("cp1252", "ignore")}
_CHARACTER_OF = {b: c for c, b in _BYTE_OF.items()}
_DAMAGED = re.compile(f"[{''.join(map(re.escape, _BYTE_OF))}]{{2,}}")


def _as_it_was(error: UnicodeDecodeError) -> tuple[str, int]:
    """Bytes that are no UTF-8 stand for the characters that they were made from."""
    return "".join(_CHARACTER_OF[b] for b in error.object[error.start : error.end]), error.end


codecs.register_error("tramline.as_it_was", _as_it_was)


def _repair(text: str) -> str:
    """Undo UTF-8 that was read as Windows-1252: each run of its characters is made bytes and read as UTF-8 once more."""
    return _DAMAGED.sub(lambda run: bytes(map(_BYTE_OF.__getitem__, run[0])).decode("utf-8", "tramline.as_it_was"), text)


def repair_mojibake(text: Column) -> Column:
    """Text whose UTF-8 bytes were once read as Windows-1252, put right. Spark's decode() has no such charset."""

    @F.pandas_udf("string")
    def fix(values: pd.Series) -> pd.Series:
        return values.map(_repair, na_action="ignore")

    return fix(text)
