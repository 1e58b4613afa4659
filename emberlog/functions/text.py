"""Scalar text functions as column expressions."""

from __future__ import annotations

import base64
import binascii

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\r\n\x0b\x0c "
# Texts that stand for nothing.
EMPTY_MARKS = ("-", "?", "null", "NULL")


def clean_text(c: Column) -> Column:
    """Trimmed; blank and the usual marks of nothing become null."""
    t = F.btrim(c, F.lit(WHITE))
    return F.when((t != "") & ~t.isin(*EMPTY_MARKS), t)


def blank(c: Column) -> Column:
    return F.coalesce(F.btrim(c, F.lit(WHITE)) == "", F.lit(True))


def contains_ci(haystack: Column, needle: str | Column) -> Column:
    """Case-insensitive containment; null holds nothing."""
    needle = F.lit(needle.lower()) if isinstance(needle, str) else F.lower(needle)
    return F.coalesce(F.contains(F.lower(haystack), needle), F.lit(False))


def equals_ci(a: Column, b: str | Column) -> Column:
    b = F.lit(b.lower()) if isinstance(b, str) else F.lower(b)
    return F.coalesce(F.lower(a) == b, F.lit(False))


def contains_any(haystack_lower: Column, tokens) -> Column:
    """Whether an already lower-cased text holds any of the tokens."""
    return F.coalesce(F.exists(F.array(*(F.lit(t.lower()) for t in tokens)), lambda t: F.contains(haystack_lower, t)), F.lit(False))


def file_name(path: Column) -> Column:
    """What follows the last slash of either kind; null for blank paths or names."""
    name = F.regexp_extract(F.btrim(path, F.lit(WHITE)), r"([^\\/]*)$", 1)
    return F.when(name != "", name)


def sha256_hex(c: Column) -> Column:
    """Upper-case hex of SHA-256; blank gives ''."""
    return F.when(blank(c), F.lit("")).otherwise(F.upper(F.sha2(c, 256)))


# Accepted time formats.
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd")


def parse_utc(c: Column) -> Column:
    """A UTC time from any accepted form; null if none fits. Below microseconds digits are cut."""
    t = F.btrim(F.btrim(c, F.lit(WHITE)), F.lit('"'))
    t = F.regexp_replace(t, r"(\.\d{6})\d+", "$1")
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(f)) for f in TIME_FORMATS), t.try_cast("timestamp"))


def parse_int(c: Column) -> Column:
    """Decimal or 0x-hex whole numbers; others give null."""
    t = F.btrim(c, F.lit(WHITE))
    hexed = F.lower(t).rlike("^0x[0-9a-f]{1,8}$")
    value = F.conv(F.substring(t, 3, 8), 16, 10).cast("long")
    signed = F.when(value > 2147483647, value - 4294967296).otherwise(value)
    return F.when(hexed, signed).otherwise(t.try_cast("int")).cast("int")


def parse_event_ids(c: Column) -> Column:
    """A comma list of ids; tokens that are no numbers are skipped."""
    return F.filter(F.transform(F.split(c, "[,;]"), lambda t: F.trim(t).try_cast("int")), lambda x: x.isNotNull())


def normalize_technique_id(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.trim(c), r"(?i)^attack\.", ""))


def normalize_tactic(c: Column) -> Column:
    return F.translate(F.lower(F.regexp_replace(F.trim(c), r"(?i)^attack\.", "")), "_ ", "--")


def parse_hashes(c: Column) -> Column:
    """``ALG=value`` lists as a map with upper-case algorithms."""
    pairs = F.filter(F.split(c, ","), lambda p: p.contains("="))
    keyed = F.transform(pairs, lambda p: F.struct(F.upper(F.trim(F.substring_index(p, "=", 1))).alias("k"), F.trim(F.regexp_extract(p, "=(.*)$", 1)).alias("v")))
    names = F.array_distinct(F.transform(keyed, lambda x: x["k"]))
    last = F.transform(names, lambda n: F.element_at(F.filter(keyed, lambda x: x["k"] == n), -1)["v"])
    return F.map_from_arrays(names, last)


def hash_value(hashes: Column, algorithm: str) -> Column:
    v = F.trim(F.regexp_extract(hashes, rf"(?i)(?:^|,)\s*{algorithm}\s*=\s*([^,]*)", 1))
    return F.when(v != "", v)


def sam_account_name(c: Column) -> Column:
    """What follows the last backslash, unless nothing does."""
    t = F.trim(c)
    name = F.substring_index(t, "\\", -1)
    return F.when(name != "", name).otherwise(t)


def export_cell(c: Column, most: int = 32_000) -> Column:
    return F.left(F.trim(F.translate(F.coalesce(c.cast("string"), F.lit("")), "\r\n\t", "   ")), F.lit(most))


def export_list(c: Column, separator: str = " | ") -> Column:
    return F.coalesce(F.array_join(c.cast("array<string>"), separator), F.lit(""))


def export_bool(c: Column) -> Column:
    return F.when(c, "yes").when(~c, "no").otherwise("")


def export_time(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def ids_to_json(c: Column) -> Column:
    return F.to_json(c)


def ids_from_json(c: Column) -> Column:
    """An id list from JSON; a broken one is empty."""
    return F.coalesce(F.from_json(c, "array<bigint>"), F.array().cast("array<bigint>"))


def split_domain_user(c: Column) -> Column:
    """struct(domain, user) of ``DOMAIN\\user``, at the first backslash."""
    cut = F.contains(c, F.lit("\\"))
    return F.struct(F.when(cut, F.regexp_extract(c, r"^([^\\]*)", 1)).alias("domain"), F.when(cut, F.regexp_extract(c, r"(?s)^[^\\]*\\(.*)$", 1)).otherwise(c).alias("user"))


def decode_base64_preview(token: Column) -> Column:
    """Text of a base64 token: UTF-16 if that gives any printable character, else UTF-8. Never run.

    The built-in decoder fails the job on odd bytes, so an Arrow batch function does it; it is meant
    for the few rows that a detector has flagged.
    """
    def decode(value):
        if value is None or not value.strip():
            return None
        t = value.strip().strip("'\"")
        t += "=" * (-len(t) % 4)
        try:
            data = base64.b64decode(t, validate=True)
        except (binascii.Error, ValueError):
            return None
        if len(data) >= 2 and len(data) % 2 == 0:
            text = data.decode("utf-16-le", "replace")
            if any(ch.isprintable() or ch in "\r\n\t" for ch in text):
                return text
        return data.decode("utf-8", "replace")

    @F.pandas_udf("string")
    def preview(values: pd.Series) -> pd.Series:
        return values.map(decode)

    return preview(token)
