"""Readers: CSV, JSON and Parquet, with header clean-up, null words and flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainfold.functions import columns as fc
from grainfold.functions.columns import finite, is_fractional, ref


class ReadError(ValueError):
    """The input cannot be read as a table."""


# Cell texts that mean "missing" in a CSV file.
NULL_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Keys under which a JSON object may hold its list of records.
RECORD_KEYS = ("data", "records", "rows", "items")


def detect_source(name: str, content_type: str = "") -> str:
    """csv, json or parquet from file name or content type; csv when unknown."""
    name = (name or "").lower().rstrip("/")
    for kind in ("csv", "json", "parquet"):
        if name.endswith("." + kind) or kind in content_type:
            return kind
    if name.endswith((".jsonl", ".ndjson")):
        return "json"
    if name.endswith((".xlsx", ".xls")) or "spreadsheet" in content_type:
        raise ReadError("spreadsheets are not supported; save the sheet as CSV")
    return "csv"


def load(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    """Read a table and bring it into the common shape."""
    kind = kind or detect_source(path)
    readers = {"csv": read_csv, "json": read_json, "parquet": read_parquet}
    if kind not in readers:
        raise ReadError(f"source type '{kind}' is not supported")
    # Parquet keeps its columns as they are, so that filters reach the files; the
    # operators read NaN as missing wherever they use a number.
    return normalize(readers[kind](spark, path, **options), nan_to_null=kind != "parquet")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _quotes_span_lines(spark: SparkSession, path: str) -> bool:
    """True when some line holds an odd number of quotes, so a cell goes over a line end."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str, infer: bool = True, multi_line: bool | None = None) -> DataFrame:
    """CSV with header. Files stay splittable unless quoted cells really span lines."""
    if multi_line is None:
        multi_line = _quotes_span_lines(spark, path)
    raw = spark.read.csv(
        path, header=True, inferSchema=False, multiLine=multi_line, quote='"', escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, enforceSchema=False,
    )
    return infer_types(words_to_null(raw)) if infer else words_to_null(raw)


def words_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[
        F.when(~ref(c).isin(*NULL_WORDS), ref(c)).alias(c) if isinstance(df.schema[c].dataType, T.StringType) else ref(c)
        for c in df.columns
    ])


def infer_types(df: DataFrame) -> DataFrame:
    """Give text columns the type all their values share: whole number, number, boolean or text."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    checks: list[Column] = []
    for i, c in enumerate(texts):
        v = ref(c)
        checks += [
            F.count(v).alias(f"n{i}"),
            F.count(fc.decimal_text(v).try_cast("bigint")).alias(f"i{i}"),
            F.count(fc.decimal_text(v).try_cast("double")).alias(f"d{i}"),
            F.count_if(F.lower(v).isin("true", "false")).alias(f"b{i}"),
        ]
    seen = df.agg(*checks).first()
    types = {}
    for i, c in enumerate(texts):
        n = seen[f"n{i}"]
        if n == 0 or n == seen[f"d{i}"]:
            types[c] = "bigint" if n and n == seen[f"i{i}"] else "double"
        elif n == seen[f"b{i}"]:
            types[c] = "boolean"
    return df.select(*[ref(c).try_cast(types[c]).alias(c) if c in types else ref(c) for c in df.columns])


def read_json(spark: SparkSession, path: str, lines: bool | None = None) -> DataFrame:
    """JSON records: one per line, a list, or an object that holds the list under a known key."""
    if lines is None:
        lines = path.lower().endswith((".jsonl", ".ndjson"))
    raw = spark.read.json(path, multiLine=not lines)
    if "_corrupt_record" in raw.columns:
        raise ReadError("unsupported JSON structure")
    for key in RECORD_KEYS:
        if key in raw.columns and isinstance(raw.schema[key].dataType, T.ArrayType):
            if not isinstance(raw.schema[key].dataType.elementType, T.StructType):
                raise ReadError(f"the list under '{key}' holds no records")
            raw = raw.select(F.explode(ref(key)).alias("_r")).select("_r.*")
            break
    return flatten(raw)


def flatten(df: DataFrame, separator: str = ".") -> DataFrame:
    """Nested objects become ``parent.child`` columns; lists stay as they are."""

    def leaves(schema: T.StructType, path: tuple[str, ...]):
        for field in schema.fields:
            here = (*path, field.name)
            if isinstance(field.dataType, T.StructType):
                yield from leaves(field.dataType, here)
            else:
                yield here

    def at(path: tuple[str, ...]) -> Column:
        c = ref(path[0])
        for step in path[1:]:
            c = c.getField(step)
        return c

    return df.select(*[at(p).alias(separator.join(p)) for p in leaves(df.schema, ())])


def expand_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Parse a text column of JSON objects and flatten it to ``column.key`` columns."""
    return flatten(df.withColumn(column, F.from_json(ref(column), schema)))


def normalize(df: DataFrame, check_empty: bool = True, nan_to_null: bool = True) -> DataFrame:
    """Strip headers, keep them apart, turn NaN into null, refuse an empty table."""
    names, used = [], set()
    for c in df.columns:
        name, base, i = c.strip(), c.strip(), 1
        while name.lower() in used:
            name, i = f"{base}_{i}", i + 1
        used.add(name.lower())
        names.append(name)
    out = df.toDF(*names)
    if nan_to_null:
        out = out.select(*[
            finite(ref(f.name)).alias(f.name) if is_fractional(f.dataType) else ref(f.name) for f in out.schema.fields
        ])
    if check_empty and out.isEmpty():
        raise ReadError("the table contains no rows")
    return out
