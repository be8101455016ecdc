"""Data profile: per-column summaries, value counts, correlations, quality score.

The numbers of all columns come from a fixed number of jobs, whatever the
number of columns: per kind of column (numbers, texts, times) one scan for
counts and one shuffle of the distinct values, and one scan for outliers. Only
one row per column reaches the driver; it decides the semantic types, which
every later step needs to know before it can be planned. Parts that are not
asked for are not computed.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainfold.functions import columns as fc
from grainfold.functions.columns import ref
from grainfold.operators import stats

MAX_CATEGORIES = 50
CATEGORY_RATIO = 0.5
ID_RATIO = 0.95
DATE_SHARE = 0.8

# Words in a column name that point to a prediction target.
TARGET_WORDS = (
    "target", "label", "churn", "fraud", "revenue", "sales", "price",
    "conversion", "outcome", "status", "score", "amount", "profit",
)

COLUMN_SCHEMA = (
    "position int, name string, dtype string, semantic_type string, missing bigint, missing_pct double, "
    "unique bigint, unique_pct double, is_probable_id boolean, non_null bigint, min double, max double, "
    "mean double, median double, std double, skew double, q1 double, q3 double, outliers bigint, "
    "outlier_pct double, zeros bigint, negatives bigint, min_date timestamp_ntz, max_date timestamp_ntz, "
    "bytes bigint"
)

# Bytes of one value of a fixed-width type.
_WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8}


def _pct(part, whole, digits=2):
    return round(part / whole * 100, digits) if whole else 0.0


class Profile:
    """Profile of one table. Frames are built on demand and hold no table rows."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.spark = df.sparkSession

    # --- one row per column -------------------------------------------------------

    def _of_kind(self, kind: str) -> list[T.StructField]:
        def kind_of(dtype: T.DataType) -> str:
            return "number" if fc.is_numeric(dtype) else "time" if fc.is_temporal(dtype) else "text"

        return [f for f in self.df.schema.fields if kind_of(f.dataType) == kind]

    @cached_property
    def _numbers(self) -> dict[str, T.Row]:
        """Counts and moments of the numeric columns; one scan of just these columns."""
        values, v = self.numbers(), F.col("v")
        if not values:
            return {}
        rows = self.df.select(*stats.stacked(values)).groupBy("c").agg(
            F.count("*").alias("n"), F.count(v).alias("k"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"),
            F.when(F.count(v) > 1, F.stddev_samp(v)).alias("std"), stats.sample_skewness(v).alias("skew"),
            F.count_if(v == 0).alias("zeros"), F.count_if(v < 0).alias("negatives"), F.approx_count_distinct(v).alias("about"))
        return {r["c"]: r for r in rows.collect()}

    def _dated(self, values: dict[str, Column], dtype: T.DataType) -> dict[str, T.Row]:
        if not values:
            return {}
        v = F.col("v")
        size = F.sum(F.octet_length(v)) if isinstance(dtype, T.StringType) else F.lit(None)
        rows = self.df.select(*stats.stacked(values)).withColumn("d", fc.parse_date(v, dtype)).groupBy("c").agg(
            F.count("*").alias("n"), F.count(v).alias("k"), F.count("d").alias("dates"), F.min("d").alias("min_date"),
            F.max("d").alias("max_date"), size.cast("bigint").alias("bytes"))
        return {r["c"]: r for r in rows.collect()}

    @cached_property
    def _texts(self) -> dict[str, T.Row]:
        """Counts, sizes and date shares of text columns (nested values as their JSON text)."""
        return self._dated({
            f.name: ref(f.name).cast("string") if fc.is_atomic(f.dataType) else F.to_json(F.struct(ref(f.name)))
            for f in self._of_kind("text")}, T.StringType())

    @cached_property
    def _times(self) -> dict[str, T.Row]:
        return self._dated({f.name: ref(f.name).cast("timestamp_ntz") for f in self._of_kind("time")}, T.TimestampNTZType())

    @property
    def _scan(self) -> dict[str, T.Row]:
        return self._numbers | self._texts | self._times

    @cached_property
    def n_rows(self) -> int:
        for known in ("_numbers", "_texts", "_times"):
            if self.__dict__.get(known):
                return next(iter(self.__dict__[known].values()))["n"]
        return self.df.count()

    @cached_property
    def _text_distinct(self) -> dict[str, int]:
        names = [f.name for f in self._of_kind("text") if fc.is_atomic(f.dataType)]
        return {r["c"]: r["u"] for r in stats.distinct_counts(self.df, names).collect()} if names else {}

    @cached_property
    def _number_values(self) -> tuple[dict[str, int], dict[str, dict]]:
        """(distinct counts, fences) of the numeric columns, from one table of value counts where that is safe."""
        values = self.numbers()
        if not values:
            return {}, {}
        scan = self._numbers.values()
        exact = all(max(abs(r["min"] or 0), abs(r["max"] or 0)) < 2 ** 53 for r in scan)  # doubles still tell them apart
        if exact and max(r["about"] for r in scan) <= stats.DISTINCT_LIMIT:
            rows = stats.values_and_quantiles(self.df, values, [0.25, 0.5, 0.75]).collect()
            return {r["c"]: r["u"] for r in rows}, {r["c"]: stats.fence(*r["q"]) for r in rows if r["q"] is not None}
        distinct = {r["c"]: r["u"] for r in stats.distinct_counts(self.df, list(values)).collect()}
        return distinct, {c: f for c, f in stats.fences(self.df, values).items() if f["low"] is not None}

    @cached_property
    def _time_distinct(self) -> dict[str, int]:
        names = [f.name for f in self._of_kind("time")]
        return {r["c"]: r["u"] for r in stats.distinct_counts(self.df, names).collect()} if names else {}

    @property
    def _distinct(self) -> dict[str, int]:
        return self._number_values[0] | self._text_distinct | self._time_distinct

    def _start_all(self) -> None:
        """Run the jobs of the column kinds side by side; none needs another's result."""
        with ThreadPoolExecutor(5) as pool:
            wanted = ("_number_values", "_texts", "_times", "_text_distinct", "_time_distinct")
            for done in [pool.submit(getattr, self, name) for name in wanted]:
                done.result()

    @staticmethod
    def _bytes(f: T.StructField, scan) -> int:
        """Logical bytes: text length, or the width of the type times the present values."""
        if scan is None:
            return 0
        if isinstance(f.dataType, T.StringType) or not fc.is_atomic(f.dataType):
            return scan["bytes"] or 0
        return scan["k"] * _WIDTHS.get(f.dataType.simpleString(), 8)

    def _semantic(self, f: T.StructField) -> str:
        if isinstance(f.dataType, T.BooleanType):
            return "boolean"
        if fc.is_temporal(f.dataType):
            return "datetime"
        if fc.is_numeric(f.dataType):
            return "numeric"
        if f.name not in self._texts:
            return "text"
        present = self._texts[f.name]["k"]
        if isinstance(f.dataType, T.StringType) and present and self._texts[f.name]["dates"] / present >= DATE_SHARE:
            return "datetime"
        unique = self._text_distinct.get(f.name, 0)
        if fc.is_atomic(f.dataType) and present and unique / present <= CATEGORY_RATIO and unique <= MAX_CATEGORIES:
            return "categorical"
        return "text"

    @cached_property
    def semantic_types(self) -> dict[str, str]:
        return {f.name: self._semantic(f) for f in self.df.schema.fields}

    def names(self, *types: str) -> list[str]:
        return [n for n, t in self.semantic_types.items() if t in types]

    def numbers(self) -> dict[str, Column]:
        return {f.name: fc.number_of(self.df, f.name) for f in self._of_kind("number")}

    @cached_property
    def rows(self) -> list[dict]:
        """The column summaries as plain records, one per column."""
        self._start_all()
        values, outside = self.numbers(), {}
        quartiles = self._number_values[1]
        if quartiles:
            beyond = {c: F.when((values[c] < f["low"]) | (values[c] > f["high"]), 1) for c, f in quartiles.items()}
            outside = self.df.agg(*[F.count(b).alias(c) for c, b in beyond.items()]).first().asDict()
        all_columns, n, distinct = self._scan, self.n_rows, self._distinct
        out = []
        for i, f in enumerate(self.df.schema.fields):
            scan = all_columns.get(f.name)
            present, unique = scan["k"] if scan else 0, distinct.get(f.name, 0)
            semantic, missing = self.semantic_types[f.name], n - present
            entry = {
                "position": i, "name": f.name, "dtype": f.dataType.simpleString(), "semantic_type": semantic,
                "missing": missing, "missing_pct": _pct(missing, n), "unique": unique,
                "unique_pct": _pct(unique, n), "non_null": present,
                "is_probable_id": bool(n and unique / n >= ID_RATIO and missing == 0),
                "bytes": self._bytes(f, scan),
            }
            if semantic == "numeric" and present:
                q, beyond = quartiles[f.name], outside.get(f.name, 0)
                entry |= {k: scan[k] for k in ("min", "max", "mean", "std", "skew", "zeros", "negatives")}
                entry |= {"median": q["median"], "q1": q["q1"], "q3": q["q3"], "outliers": beyond,
                          "outlier_pct": _pct(beyond, present)}
            elif semantic == "datetime":
                entry |= {"min_date": scan["min_date"], "max_date": scan["max_date"]}
            out.append(entry)
        return out

    @cached_property
    def columns(self) -> DataFrame:
        names = [f.name for f in T.StructType.fromDDL(COLUMN_SCHEMA).fields]
        return self.spark.createDataFrame([tuple(r.get(k) for k in names) for r in self.rows], COLUMN_SCHEMA)

    def column_meta(self) -> DataFrame:
        return self.columns.select("name", "semantic_type", "unique", "missing_pct")

    # --- frames derived from the column rows -----------------------------------------

    @cached_property
    def duplicates(self) -> int:
        return stats.duplicate_rows(self.df).first()[0]

    def summary(self) -> DataFrame:
        """rows, columns, duplicates, missing cells and numeric columns of the table."""
        n = self.n_rows
        return self.columns.agg(
            F.lit(n).cast("bigint").alias("rows"),
            F.count("*").alias("columns"),
            F.lit(self.duplicates).cast("bigint").alias("duplicate_rows"),
            F.lit(_pct(self.duplicates, n)).alias("duplicate_pct"),
            F.sum("missing").alias("total_missing_cells"),
            F.count_if(F.col("semantic_type") == "numeric").alias("numeric_columns"),
            F.sum("bytes").alias("bytes"),
        )

    def top_values(self, k: int = 10) -> DataFrame:
        """(column, value, count, pct, rank) of categorical, boolean and text columns."""
        names = [c for c in self.names("categorical", "boolean", "text") if c in stats.countable(self.df)]
        if not names:
            return self.spark.createDataFrame(
                [], "column string, value string, count bigint, pct double, rank int")
        counts = stats.value_counts(self.df, names)
        share = F.round(F.col("count") / F.lit(max(self.n_rows, 1)) * 100, 2)
        return stats.top_values(counts, k).select("column", "value", "count", share.alias("pct"), "rank")

    def missing_report(self) -> DataFrame:
        return (
            self.columns.where("missing > 0")
            .select(F.col("name").alias("column"), "missing", "missing_pct", "position")
            .orderBy(F.desc("missing_pct"), "position").drop("position")
        )

    def type_counts(self) -> DataFrame:
        return self.columns.groupBy("semantic_type").agg(F.count("*").alias("columns"))

    def categorical(self) -> DataFrame:
        """Distinct count and common values of categorical and boolean columns."""
        kinds = self.columns.where(F.col("semantic_type").isin("categorical", "boolean"))
        return kinds.select(F.col("name").alias("column"), "unique").join(self.top_values(), "column")

    def keys(self) -> DataFrame:
        return self.columns.where("is_probable_id").select("position", F.col("name").alias("column"))

    def dates(self) -> DataFrame:
        return self.columns.where("semantic_type = 'datetime'").select("position", F.col("name").alias("column"))

    def datetimes(self) -> DataFrame:
        return self.columns.where("semantic_type = 'datetime'").select(
            F.col("name").alias("column"), "min_date", "max_date")

    def correlations(self) -> DataFrame:
        """(a, b, corr) of all numeric pairs, rounded to three digits."""
        pairs = stats.correlation_pairs(self.df, self.numbers())
        return pairs.where(F.col("corr").isNotNull()).withColumn("corr", F.round("corr", 3))

    def top_pairs(self, k: int = 8) -> DataFrame:
        return self.correlations().orderBy(F.desc(F.abs("corr")), "a", "b").limit(k)

    def target_suggestions(self, k: int = 5) -> DataFrame:
        """Likely prediction targets with task and confidence, best first."""
        named = F.lower("name").rlike("|".join(TARGET_WORDS))
        few = (F.col("semantic_type") == "categorical") & F.col("unique").between(2, 10)
        wide = (F.col("semantic_type") == "numeric") & (F.col("unique_pct") > 5)
        confidence = F.when(named, 0.75).when(few, 0.6).when(wide, 0.5)
        task = F.when(F.col("semantic_type").isin("categorical", "boolean"), "classification").otherwise("regression")
        return (
            self.columns.where(~F.col("is_probable_id") & (F.col("missing_pct") <= 40))
            .select("position", F.col("name").alias("column"), task.alias("task"), confidence.alias("confidence"))
            .where(F.col("confidence").isNotNull())
            .orderBy(F.desc("confidence"), "position").limit(k)
        )

    def quality(self) -> DataFrame:
        """Quality score 0 to 100 with its four parts and a grade."""
        dup = self.duplicates / self.n_rows * 100 if self.n_rows else 0.0
        parts = self.columns.agg(
            F.greatest(F.lit(0.0), 100 - F.avg("missing_pct")).alias("completeness"),
            F.greatest(F.lit(0.0), 100 - F.coalesce(F.avg("outlier_pct"), F.lit(0.0))).alias("validity"),
            (100 - F.least(F.lit(20.0), F.count_if(F.col("semantic_type") == "text") * 2.0)).alias("consistency"),
        ).withColumn("uniqueness", F.lit(max(0.0, 100 - dup)))
        score = F.round(
            0.4 * F.col("completeness") + 0.25 * F.col("uniqueness")
            + 0.2 * F.col("validity") + 0.15 * F.col("consistency"), 1)
        return parts.withColumn("score", score).select(
            "score", fc.grade(F.col("score")).alias("grade"),
            *[F.round(c, 1).alias(c) for c in ("completeness", "uniqueness", "validity", "consistency")],
        )

    def sample(self, order_by: list[str], n: int = 20) -> DataFrame:
        return self.df.orderBy(*[ref(c) for c in order_by]).limit(n)

    def report(self) -> dict:
        """The profile as one nested record."""
        def rows(frame: DataFrame) -> list[dict]:
            return [r.asDict() for r in frame.collect()]

        top: dict[str, list] = {}
        for r in sorted(rows(self.top_values()), key=lambda r: (r["column"], r["rank"])):
            top.setdefault(r["column"], []).append({k: r[k] for k in ("value", "count", "pct")})
        return {
            "dataset_summary": rows(self.summary())[0],
            "columns": [r | ({"top_values": top[r["name"]]} if r["name"] in top else {}) for r in self.rows],
            "dtypes": {r["semantic_type"]: r["columns"] for r in rows(self.type_counts())},
            "missing_report": rows(self.missing_report()),
            "correlation": {"top_pairs": rows(self.top_pairs())},
            "date_columns": self.names("datetime"),
            "probable_primary_keys": [r["name"] for r in self.rows if r["is_probable_id"]],
            "target_suggestions": rows(self.target_suggestions()),
            "quality": rows(self.quality())[0],
        }

