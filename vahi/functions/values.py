"""Money, dates and arrays: Column to Column. Sums are made in whole paise, so they do not depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_money(v: Column) -> Column:
    """A finite number as it is; of text, the number that its digits, points and signs begin with; else 0. The column's own type decides, so a double keeps its exponent."""
    digits = F.regexp_replace(v.cast("string"), "[^0-9.-]+", "")
    text = F.regexp_extract(digits, r"^-?(\d+\.?\d*|\.\d+)", 0).try_cast("double")  # nothing found is no number
    return F.coalesce(F.when(F.typeof(v) == "string", text).otherwise(_finite(v.try_cast("double"))), F.lit(0.0))


def _finite(v: Column) -> Column:
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def json_money(v: Column) -> Column:
    """C20/C21 of a JSON value (variant): a number as it is, text by clean_money, anything else 0."""
    kind = F.schema_of_variant(v)
    number = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"), F.try_variant_get(v, "$", "double"))
    return F.when(kind == "STRING", clean_money(F.try_variant_get(v, "$", "string"))).otherwise(F.coalesce(_finite(number), F.lit(0.0)))


def json_there(v: Column) -> Column:
    """A JSON value (variant), with JSON's null as null."""
    return F.when(~F.is_variant_null(v), v)


def to_paise(v: Column) -> Column:
    """Hundredths, halves rounded up."""
    return F.floor(v * 100 + F.lit(0.5)).cast("long")


def to_rupees(p: Column) -> Column:
    """C23."""
    return p / F.lit(100.0)


def within(a: Column, b: Column, tolerance: float) -> Column:
    """Inclusive."""
    return F.abs(a - b) <= F.lit(tolerance)


def line_tolerance(price: Column) -> Column:
    """C25."""
    return F.greatest(F.lit(2.0), price * F.lit(0.02))


def length_ratio(a: Column, b: Column) -> Column:
    """The shorter length over the longer."""
    return F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, halves up; null for nothing."""
    return F.when(whole != 0, F.floor(part * F.lit(100.0) / whole + F.lit(0.5)).cast("long"))


def two_places(p: Column) -> Column:
    """Paise as text with two decimals, made from whole numbers."""
    whole = F.abs(p)
    return F.concat(F.when(p < 0, F.lit("-")).otherwise(F.lit("")), F.floor(whole / 100).cast("string"), F.lit("."), F.lpad((whole % 100).cast("string"), 2, "0"))


def clean_date(v: Column, as_of: Column) -> Column:
    """d/m/yyyy, d-m-yyyy or ISO text as a timestamp; nulls and others become as_of, which callers fix so that runs repeat."""
    slash, dash = (F.try_to_timestamp(v, F.lit(p)) for p in ("d/M/yyyy", "d-M-yyyy"))
    iso = F.when(v.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), v.try_cast("timestamp"))
    return F.coalesce(F.when(v.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), slash), F.when(v.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), dash), iso, as_of)


def parse_date(v: Column) -> Column:
    """d/m/y or d-m-y, two-digit years from 2000, or ISO text; others are null."""
    part = lambda k: F.nullif(F.regexp_extract(v, r"^\s*(\d{1,2})[/-](\d{1,2})[/-](\d{2}|\d{4})\s*$", k), F.lit("")).cast("int")
    year = F.when(part(3) < 100, part(3) + 2000).otherwise(part(3))
    ymd = F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(part(2).cast("string"), 2, "0"), F.lpad(part(1).cast("string"), 2, "0")), "yyyy-MM-dd")
    iso = F.when(v.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), v.try_cast("date"))
    return F.when(part(1).isNotNull(), ymd).otherwise(iso)


def month_key(ts: Column) -> Column:
    """C32."""
    return F.date_format(ts, "yyyy-MM")


def in_future(ts: Column, as_of: Column) -> Column:
    """More than a day ahead."""
    return ts > as_of + F.expr("INTERVAL 1 DAY")


def compact_date(ts: Column) -> Column:
    """C34."""
    return F.date_format(ts, "yyyyMMdd")


def rows_in(array: Column) -> Column:
    """An array's length, 0 for none."""
    return F.coalesce(F.size(array), F.lit(0))

