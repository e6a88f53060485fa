"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from edgetide.model import TYPES


def fmt_type(code: Column) -> Column:
    """A type code's name."""
    return _lookup(code, {c: t[0] for c, t in TYPES.items()})


def type_size(code: Column) -> Column:
    return _lookup(code, {c: t[1] for c, t in TYPES.items()})


def is_integer_type(code: Column) -> Column:
    """Whether a code is of an integer type; NONE counts as one."""
    return F.when(code.isin(*TYPES), code < 30)


def op_name(op: Column) -> Column:
    return F.when(op == 0, "INSERT").when(op == 1, "DELETE")


def _lookup(code: Column, values: dict) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(code == k, v) if out is None else out.when(code == k, v)
    return out


def op_parse(text: Column) -> Column:
    """1 for 1, delete and del in either case, else 0."""
    return F.when(F.lower(F.trim(text.cast("string"))).isin("1", "delete", "del"), 1).otherwise(0).cast("byte")


def parse_ymdhm(text: Column) -> Column:
    """Seconds since 1970 of yyyymmddHHMM in UTC; null where it is none."""
    return _utc_seconds(text, "yyyyMMddHHmm")


def parse_iso_z(text: Column) -> Column:
    return _utc_seconds(F.regexp_replace(text, "Z$", ""), "yyyy-MM-dd'T'HH:mm:ss")


def parse_git_date(text: Column) -> Column:
    """Seconds since 1970 of a date with an offset, such as 2024-01-31 10:00:00 +0200."""
    sign = F.when(F.substring(text, 21, 1) == "-", -1).otherwise(1)
    offset = sign * (F.substring(text, 22, 2).try_cast("int") * 3600 + F.substring(text, 24, 2).try_cast("int") * 60)
    return _utc_seconds(F.substring(text, 1, 19), "yyyy-MM-dd HH:mm:ss") - offset


def _utc_seconds(text: Column, pattern: str) -> Column:
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz"))


def seconds_since(text: Column, origin: str = "2018-12-31 00:00:00") -> Column:
    return _utc_seconds(text, "yyyy-MM-dd HH:mm:ss") - _utc_seconds(F.lit(origin), "yyyy-MM-dd HH:mm:ss")


def hex_to_int(text: Column) -> Column:
    return F.conv(F.regexp_replace(text, "^0[xX]", ""), 16, 10).cast("long")


def wiki_links(text: Column) -> Column:
    """Targets of [[links]] within a line, cut at | and #, without empty and repeated ones."""
    found = F.regexp_extract_all(text, F.lit(r"\[\[(.*?)\]\]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.regexp_extract(x, r"^[^|#]*", 0)), lambda x: x != ""))


def split_semicolon(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x != "")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6_378_100.0) -> Column:
    """Metres along a great circle between two places in degrees."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.lit(2 * radius) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def dataset_name(path: Column) -> Column:
    """A path's last part without its extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def avg_degree(edges: Column, nodes: Column) -> Column:
    return F.try_divide(edges.cast("double"), nodes)


def alive_fraction(alive: Column, total: Column) -> Column:
    return F.try_divide(alive.cast("double"), total)


def epoch_to_date(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def hash64(x: Column, seed: int = 0) -> Column:
    return F.xxhash64(F.lit(seed), x)


def hash32(x: Column, seed: int = 0) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), x), 32)


def json_num(text: Column, field: str) -> Column:
    """A field's number; null where it is missing or none."""
    return F.get_json_object(text, f"$.{field}").try_cast("double")


def has_numeric_field(text: Column, field: str) -> Column:
    return json_num(text, field).isNotNull()


#: Title prefixes of pages that are no articles.
PREFIXES = ("User:", "Wikipedia:", "WP:", "Project:", "Image:", "image:", "File:", "file:", "MediaWiki:", "Template:", "Help:", "Category:", "Portal:", "Draft:", "TimedText:", "Module:", "Talk:", "User Talk:", "User talk:", "Template talk:", "Wikipedia talk:", "Portal talk:")


def in_namespace(title: Column, prefixes: tuple[str, ...] = PREFIXES) -> Column:
    """Whether a title begins with one of the prefixes."""
    return title.rlike("^(?:" + "|".join(prefixes) + ")")
