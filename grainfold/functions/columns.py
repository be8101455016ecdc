"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ref(name: str) -> Column:
    """Column by its exact name, also when the name holds dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_fractional(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_atomic(dtype: T.DataType) -> bool:
    return not isinstance(dtype, (T.ArrayType, T.MapType, T.StructType))


# --- numbers -------------------------------------------------------------------

def finite(c: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def to_number(c: Column, dtype: T.DataType | None = None) -> Column:
    """Number as double; anything that is not a finite number is null."""
    if dtype is not None and is_numeric(dtype) and not is_fractional(dtype):
        return c.cast("double")
    if dtype is not None and is_fractional(dtype):
        return finite(c.cast("double"))
    return finite(decimal_text(c).try_cast("double"))


def decimal_text(c: Column) -> Column:
    """The text of a plain decimal number; null for anything else, such as ``1d`` or ``0x1p3``, which a cast would take."""
    return F.when(c.cast("string").rlike(r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"), c.cast("string"))


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN read as missing."""
    return finite(ref(name)) if is_fractional(df.schema[name].dataType) else ref(name)


def number_of(df: DataFrame, name: str) -> Column:
    return to_number(ref(name), df.schema[name].dataType)


def clip(c: Column, low, high) -> Column:
    """Bound a value, keeping null."""
    low, high = F.lit(low), F.lit(high)
    return F.when(c < low, low).when(c > high, high).otherwise(c)


def log1p_floor0(c: Column) -> Column:
    return F.when(c.isNotNull(), F.log1p(F.greatest(c, F.lit(0.0))))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def grade(score: Column) -> Column:
    return (F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C")
            .when(score >= 60, "D").otherwise("F"))


def skew_label(skew: Column) -> Column:
    return (F.when(skew > 0.5, "right-skewed").when(skew < -0.5, "left-skewed")
            .otherwise("roughly symmetric"))


def strength_label(r: Column) -> Column:
    return (F.when(F.abs(r) >= 0.7, "strong").when(F.abs(r) >= 0.4, "moderate")
            .otherwise("weak"))


# --- text ----------------------------------------------------------------------

def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def title_case(c: Column) -> Column:
    """Capital after every non-letter: each run of letters is capitalised by itself."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def split_at(c: Column, separator: str, index: int) -> Column:
    """Piece at ``index`` (negative counts from the end), null when out of range.

    A separator of one character is literal, a longer one is a pattern.
    """
    pattern = re.sub(r"([^\w\s])", r"\\\1", separator) if len(separator) == 1 else separator
    position = index + 1 if index >= 0 else index
    return F.try_element_at(F.split(c, pattern), F.lit(position))


def concat_keep(columns: list[Column], separator: str) -> Column:
    """Join texts; null counts as the empty text so that positions stay in place."""
    return F.concat_ws(separator, *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])


def humanize(c: Column) -> Column:
    """``SalePrice`` and ``monthly_charges`` become ``Sale Price`` and ``Monthly Charges``."""
    spaced = F.regexp_replace(c, r"[_\-.]+", " ")
    spaced = F.regexp_replace(spaced, r"(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.initcap(strip(F.regexp_replace(spaced, r"\s+", " ")))


def slug(c: Column) -> Column:
    """Lower-case words joined by one underscore, none at the ends; ``dataset`` if empty."""
    text = F.lower(F.regexp_replace(F.regexp_replace(c, r"[^a-zA-Z0-9]+", "_"), r"^_+|_+$", ""))
    return F.when(text == "", "dataset").otherwise(text)


# --- casts ---------------------------------------------------------------------

# Words read as booleans.
TRUE_WORDS = ("true", "1", "yes", "y", "t")
FALSE_WORDS = ("false", "0", "no", "n", "f")


def to_boolean(c: Column) -> Column:
    word = F.lower(strip(c.cast("string")))
    word = F.regexp_replace(word, r"^([01])\.0$", "$1")
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def to_integer(c: Column, dtype: T.DataType) -> Column:
    """Whole number or null; a number with a fraction is an error, not a rounding."""
    if is_numeric(dtype) and not is_fractional(dtype) and not isinstance(dtype, T.DecimalType):
        return c.cast("bigint")
    value = to_number(c, dtype)
    whole = F.when(value.isNull(), F.lit(None).cast("bigint")).when(
        value == F.floor(value), value.cast("bigint")
    ).otherwise(F.raise_error(F.concat(F.lit("not a whole number: "), value.cast("string"))).cast("bigint"))
    if isinstance(dtype, T.StringType):
        return F.coalesce(strip(c).try_cast("bigint"), whole)
    return whole


# Shapes of date texts and the format that reads each shape.
DATE_SHAPES = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "M/d/yyyy H:mm"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "M/d/yyyy H:mm:ss"),
    (r"^[A-Za-z]{3} \d{1,2} \d{4}$", "MMM d yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Za-z]{4,} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{4,} \d{4}$", "d MMMM yyyy"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
)
_STAMP_SHAPE = r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}"
_SHORTEST_DATE, _LONGEST_DATE = 8, 40
_YEAR = r"\d{4}"


def parse_date(c: Column, dtype: T.DataType) -> Column:
    """Time stamp without zone from a column of mixed date texts, null where unreadable."""
    if is_temporal(dtype):
        return c.cast("timestamp_ntz")
    if not isinstance(dtype, T.StringType):
        return F.lit(None).cast("timestamp_ntz")
    # The cheap tests come first: most texts are no dates and stop there.
    text = F.btrim(c, F.lit(" \t\r\n"))
    parsed = F.when(text.rlike(_STAMP_SHAPE), text.try_cast("timestamp_ntz"))
    for shape, pattern in DATE_SHAPES:
        parsed = parsed.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz"))
    return F.when(F.length(c).between(_SHORTEST_DATE, _LONGEST_DATE) & c.rlike(_YEAR), parsed)


def date_of(df: DataFrame, name: str) -> Column:
    return parse_date(ref(name), df.schema[name].dataType)


DATE_PARTS = {
    "year": F.year,
    "month": F.month,
    "quarter": F.quarter,
    "week": F.weekofyear,
    "day": F.day,
    "dayofweek": F.weekday,
    "hour": F.hour,
}


def month_label(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def is_weekend(c: Column) -> Column:
    return F.when(F.weekday(c) >= 5, 1).when(c.isNotNull(), 0)


def stable_order(*keys: Column) -> Column:
    """Order that looks random but is the same on every run and in every engine."""
    return F.md5(F.concat_ws("|", *[k.cast("string") for k in keys]))
