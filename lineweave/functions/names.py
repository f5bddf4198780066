"""Names and labels."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What names lose before they are compared.
NAME_SYMBOLS = r"(?U)[\s_\-・·／／《》「」【】（）\(\)\[\]{}「」\.\,\#]"
KEY_SYMBOLS = r"(?U)[\s_\-・·\.\,\#]"
FULL_WIDTH, HALF_WIDTH = "０１２３４５６７８９", "0123456789"


@F.pandas_udf(T.StringType())
def nfc_udf(name: pd.Series) -> pd.Series:
    """Composed form; Spark has no built-in for it."""
    return name.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def name_key(name: Column, compose: bool = False, symbols: str = NAME_SYMBOLS) -> Column:
    """lower case without ``symbols``; ``compose`` first brings text to composed form."""
    return F.lower(F.regexp_replace(nfc_udf(name) if compose else name, symbols, ""))


def similar_names(a: Column, b: Column) -> Column:
    """one holds the other, or more than half of the characters agree by position."""
    same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)).cast("int")), F.lit(0), lambda acc, x: acc + x)
    short = F.least(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), False).otherwise(F.contains(a, b) | F.contains(b, a) | (same / short > 0.5))


def first_number(stem: Column) -> Column:
    """O1: the first number of a name, full-width digits included; 999999 without one."""
    digits = F.regexp_extract(stem, "[０-９0-9]+", 0)
    number = F.nullif(F.translate(digits, FULL_WIDTH, HALF_WIDTH), F.lit(""))
    return F.coalesce(number.try_cast("decimal(38,0)"), F.lit(999999))


def natural_order(parent: Column, stem: Column) -> list[Column]:
    """O1: sort keys for files: folder, number, name."""
    return [parent.asc(), first_number(stem).asc(), stem.asc()]


def safe_file_name(x: Column) -> Column:
    """separators and forbidden signs become one underscore; "track" if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(x, r'(?U)[\\/:*?"<>|\s]+', "_"), "^_+|_+$", ""), F.lit("")), F.lit("track"))


RJ = r"(?i)(RJ\d{6,})"


def work_number(path: Column) -> Column:
    """The work number in a path, upper case, or null."""
    return F.upper(F.nullif(F.regexp_extract(path, RJ, 1), F.lit("")))


def short_id(path: Column) -> Column:
    """the work number, else the last part of the path."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"(RJ\d+)", 1), F.lit("")), F.element_at(F.split(path, "/"), -1))


def sheet_label(i: Column) -> Column:
    """0 is A, 25 Z, 26 AA, 702 AAA, and so on for any number."""
    state = "struct<n:bigint,label:string>"

    def letter(s: Column, _: Column) -> Column:
        longer = F.concat(F.char(F.lit(65) + F.pmod(s["n"], F.lit(26))), s["label"])
        return F.when(s["n"] < 0, s).otherwise(F.struct((F.floor(s["n"] / 26) - 1).alias("n"), longer.alias("label")).cast(state))

    # 14 letters hold every long below 2 ** 53, where division is exact.
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.struct(i.cast("long").alias("n"), F.lit("").alias("label")).cast(state), letter)["label"]


def is_blank(x: Column) -> Column:
    """P23 for strings."""
    return F.coalesce(F.trim(x), F.lit("")) == ""


def fill_blank(user: Column, preset: Column) -> Column:
    """union of two string maps; the user's value wins unless it is blank."""
    return F.map_zip_with(user, preset, lambda k, u, p: F.when(is_blank(u), F.coalesce(p, u)).otherwise(u))


# Words in error messages.
PARAMETER_WORDS = ("unknown", "unsupported", "not support", "unexpected", "unrecognized", "invalid argument", "extra_input", "bad_request", "parameter")
NETWORK_WORDS = (
    "proxyerror", "connection broken", "max retries exceeded", "connection aborted", "connection reset", "connection refused", "remotedisconnected", "remote end closed",
    "timed out", "timeout", "sslerror", "eof occurred", "name resolution", "name or service not known", "temporary failure", "bad gateway", "gateway timeout",
)
QUOTA_WORDS = (
    "rate limit", "rate_limit", "rate-limit", "quota", "insufficient_quota", "usage limit", "usage_limit", "limit reached", "too many requests", "too_many_requests",
    "credit", "balance", "insufficient", "permission", "forbidden", "not allowed", "plan", "subscription",
)


def _holds(message: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(message)
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))


def is_unsupported_parameter(status: Column, message: Column) -> Column:
    """The service rejects an optional parameter."""
    return F.coalesce(status.isin(400, 422), F.lit(False)) | _holds(message, PARAMETER_WORDS)


def is_quota_exhausted(status: Column, message: Column) -> Column:
    """Quota or rate limit; words about the network veto it."""
    return ~_holds(message, NETWORK_WORDS) & (F.coalesce(status.isin(429, 402, 403), F.lit(False)) | _holds(message, QUOTA_WORDS))
