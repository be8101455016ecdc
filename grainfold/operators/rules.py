"""Rule tables over a profile: cleaning advice, signals, insights, risks, objectives, readiness.

A profile holds one row per column, so these are short jobs on small frames;
the tables they describe are not read again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainfold.functions import columns as fc
from grainfold.operators import analyst
from grainfold.operators.profile import Profile

# Words in a text column's name that suggest a date.
DATE_WORDS = ("date", "time", "day", "month", "year")

# Business objectives by words in the column name; the first match counts.
OBJECTIVES = (
    ("churn", "Predict Customer Churn", "high"),
    ("attrition", "Predict Employee Attrition", "high"),
    ("fraud", "Detect Fraudulent Activity", "high"),
    ("default|delinquen", "Predict Loan Default", "high"),
    ("ltv|lifetime", "Predict Customer Lifetime Value", "high"),
    ("claim", "Predict Insurance Claim Cost", "high"),
    ("demand", "Forecast Product Demand", "high"),
    ("sales", "Predict Sales", "high"),
    ("revenue", "Predict Revenue", "high"),
    ("price", "Predict Price", "high"),
    ("conversion", "Predict Conversion", "medium"),
    ("satisfaction|rating", "Predict Customer Satisfaction", "medium"),
    ("salary|income|wage", "Predict Income", "medium"),
    ("profit", "Predict Profit", "high"),
    ("cancel", "Predict Cancellations", "medium"),
    ("outcome|target|label", None, "medium"),
)


def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _null() -> Column:
    return F.lit(None).cast("string")


def cleaning_actions(profile: Profile) -> DataFrame:
    """(rule, column, action, severity, auto_safe): what should be cleaned."""
    cols, pct = profile.columns, F.col("missing_pct")
    made = lambda rule, column, action, severity, safe: [
        F.lit(rule).alias("rule"), column.alias("column"), action.alias("action"), severity.alias("severity"), safe.alias("auto_safe")]
    missing = cols.where("missing > 0").select(*made(
        "missing_values", F.col("name"), F.when(pct >= 60, "drop_column").otherwise("impute"),
        F.when(pct >= 40, "high").when(pct >= 5, "medium").otherwise("low"), pct < 5))
    duplicates = profile.summary().where("duplicate_rows > 0").select(*made(
        "duplicates", _null(), F.lit("drop_duplicates"), F.lit("medium"), F.lit(False)))
    outliers = cols.where("outlier_pct >= 5").select(*made(
        "outliers", F.col("name"), F.lit("review_or_cap"), F.lit("medium"), F.lit(False)))
    dates = cols.where((F.col("semantic_type") == "text") & F.lower("name").rlike("|".join(DATE_WORDS))).select(*made(
        "wrong_data_type", F.col("name"), F.lit("parse_datetime"), F.lit("low"), F.lit(True)))
    return _stack([missing, duplicates, outliers, dates])


def signals(profile: Profile) -> DataFrame:
    """(kind, rank, subject, other, value): what is noteworthy about a table."""
    def made(kind: str, rank, subject, other, value):
        return [F.lit(kind).alias("kind"), rank.cast("int").alias("rank"), subject.alias("subject"), other.alias("other"),
                value.cast("double").alias("value")]

    one, cols = F.lit(1), profile.columns

    def first(frame: DataFrame, order: list[Column], k: int = 3) -> DataFrame:
        # A profile has one row per column, so numbering them in one task is cheap.
        return frame.withColumn("rank", F.row_number().over(Window.orderBy(*order))).where(F.col("rank") <= k)

    return _stack([
        profile.quality().select(*made("quality", one, F.col("grade"), _null(), F.col("score"))),
        first(cols.where("missing > 0"), [F.desc("missing_pct"), F.col("position")]).select(
            *made("missing", F.col("rank"), F.col("name"), _null(), F.col("missing_pct"))),
        profile.summary().where("duplicate_pct > 1").select(*made("duplicates", one, _null(), _null(), F.col("duplicate_pct"))),
        first(profile.top_pairs().where("abs(corr) >= 0.6"), [F.desc(F.abs("corr")), F.col("a"), F.col("b")]).select(
            *made("correlation", F.col("rank"), F.col("a"), F.col("b"), F.col("corr"))),
        first(cols.where("outlier_pct >= 5"), [F.col("position")]).select(
            *made("outliers", F.col("rank"), F.col("name"), _null(), F.col("outlier_pct"))),
        analyst.imbalanced_targets(profile).select(*made("imbalance", one, F.col("column"), F.col("value"), F.col("pct"))),
    ])


_SEVERITIES = ("high", "medium", "low", "info")


def insights(profile: Profile, found: DataFrame | None = None) -> DataFrame:
    """(kind, subject, value, severity, confidence, position): one insight per kind of signal, gravest first."""
    lead = (found if found is not None else signals(profile)).where("rank = 1")
    kind, value = F.col("kind"), F.col("value")
    severity = (
        F.when(kind == "quality", F.when(value < 60, "high").when(value < 80, "medium").otherwise("info"))
        .when(kind == "missing", F.when(value > 40, "high").otherwise("medium"))
        .when(kind == "correlation", "info").otherwise("medium"))
    confidence = (
        F.when(kind == "quality", 0.9).when(kind == "missing", 0.8).when(kind == "duplicates", 0.85)
        .when(kind == "correlation", F.least(F.lit(0.9), F.abs(value))).when(kind == "outliers", 0.7).otherwise(0.75))
    rated = lead.select("kind", "subject", "value", severity.alias("severity"), confidence.alias("confidence"))
    grave = F.array_position(F.array(*[F.lit(s) for s in _SEVERITIES]), F.col("severity"))
    order = Window.orderBy(grave, F.desc("confidence"), "kind")  # at most six rows
    return rated.withColumn("position", F.row_number().over(order))


def narrative(profile: Profile) -> DataFrame:
    """One row: size, grade, the leading insight, the first target and up to five next steps."""
    found = insights(profile)
    lead = found.where("position = 1").select(F.col("kind").alias("headline"), F.col("subject").alias("headline_subject"))
    tags = found.agg(
        F.bool_or(F.col("kind").isin("missing", "duplicates", "outliers")).alias("clean"),
        F.bool_or(F.col("kind") == "imbalance").alias("balance"))
    target = profile.target_suggestions(1).agg(F.first("column").alias("target"))
    base = profile.summary().select("rows", "columns")
    for part in (profile.quality().select("grade", "score"), lead, tags, target):
        base = base.join(part, F.lit(True))  # every side has one row
    steps = F.array_compact(F.array(
        F.when(F.col("clean"), "clean flagged columns"), F.when(F.col("balance"), "balance classes"),
        F.lit("explore relationships"), F.when(F.col("target").isNotNull(), F.concat(F.lit("model "), F.col("target"))),
        F.lit("ask follow-up questions")))
    return base.select("rows", "columns", "grade", "score", "headline", "headline_subject", "target",
                       (F.col("score") >= 80).alias("ready"), F.slice(steps, 1, 5).alias("next_steps"))


def risks(profile: Profile) -> DataFrame:
    """(risk, subject, value): at most six, in a fixed order."""
    def made(i: int, risk: str, subject, value):
        return [F.lit(i).alias("_i"), F.lit(risk).alias("risk"), subject.alias("subject"), value.cast("double").alias("value"),
                F.lit(0).alias("_j")]

    cols = profile.columns
    heavy = cols.where("missing_pct > 20").orderBy(F.desc("missing_pct"), "position").limit(3).agg(
        F.max("missing_pct").alias("v"), F.array_sort(F.collect_list(F.struct(-F.col("missing_pct"), F.col("position"), F.col("name")))).alias("a"))
    names = F.array_join(F.transform("a", lambda s: s["name"]), ", ")
    out = _stack([
        profile.summary().where("duplicate_pct > 1").select(*made(1, "duplicates", _null(), F.col("duplicate_pct"))),
        heavy.where("v IS NOT NULL").select(*made(2, "missing", names, F.col("v"))),
        cols.where("outlier_pct > 5").orderBy("position").limit(1).select(*made(3, "outliers", F.col("name"), F.col("outlier_pct"))),
        insights(profile).where("severity = 'high'").select(
            F.lit(4).alias("_i"), F.col("kind").alias("risk"), "subject", "value", F.col("position").alias("_j")),
    ])
    return out.orderBy("_i", "_j").limit(6).drop("_i", "_j")


def task_of(semantic: Column, unique: Column, unique_pct: Column) -> Column:
    """classification or regression, from type and number of distinct values."""
    return F.when(
        semantic.isin("categorical", "boolean", "text") | (unique <= 2) | ((unique <= 20) & (unique_pct < 5)),
        "classification").otherwise("regression")


def objectives(profile: Profile, k: int = 6) -> DataFrame:
    """Prediction objectives, best first: target, title, task, difficulty, value, data quality."""
    name = F.lower("name")
    place, title, value = F.lit(None).cast("int"), _null(), _null()
    own = F.concat(F.lit("Predict "), fc.humanize(F.col("name")))
    for i, (words, label, worth) in reversed(list(enumerate(OBJECTIVES))):
        hit = name.rlike(words)
        place = F.when(hit, i).otherwise(place)
        title = F.when(hit, F.lit(label) if label else own).otherwise(title)
        value = F.when(hit, worth).otherwise(value)
    task = task_of(F.col("semantic_type"), F.col("unique"), F.col("unique_pct"))
    few = F.col("semantic_type").isin("categorical", "boolean") & F.col("unique").between(2, 10)
    wide = (F.col("semantic_type") == "numeric") & (F.col("unique_pct") > 5)
    top = profile.top_values(1).select(F.col("column").alias("_c"), F.col("pct").alias("_top"))
    score = profile.quality().select(F.col("score").alias("_score"))
    n = profile.n_rows
    small = F.lit(2 if n < 200 else 1 if n < 1000 else 0)
    gaps = F.when(F.col("missing_pct") > 20, 2).when(F.col("missing_pct") > 5, 1).otherwise(0)
    classes = F.when(F.col("task") == "classification",
                     (F.col("unique") > 10).cast("int") + F.when(F.coalesce("_top", F.lit(0.0)) >= 90, 2).otherwise(0)).otherwise(0)
    points = small + gaps + classes
    rated = (
        profile.columns.where(~F.col("is_probable_id") & (F.col("missing_pct") <= 40)
                              & ~F.col("semantic_type").isin("text", "datetime") & (F.col("unique") > 1))
        .withColumns({"task": task, "_place": place, "_title": title, "_value": value})
        .where(F.col("_place").isNotNull() | few | wide)
        .join(top, F.col("name") == F.col("_c"), "left").join(score, F.lit(True))  # the score is one row
        .select(
            F.col("name").alias("target"), F.coalesce("_title", own).alias("title"), "task",
            F.coalesce("_value", F.when(F.col("task") == "classification", "medium").otherwise("low")).alias("business_value"),
            F.when(points >= 3, "hard").when(points >= 1, "medium").otherwise("easy").alias("difficulty"),
            F.bround(0.6 * (100 - F.col("missing_pct")) + 0.4 * F.col("_score")).cast("int").alias("data_quality"),
            F.col("_place").isNotNull().alias("_named"), "position"))
    worth = F.when(F.col("business_value") == "high", 0).when(F.col("business_value") == "medium", 1).otherwise(2)
    order = Window.orderBy(F.desc("_named"), worth, F.desc("data_quality"), "position")  # one row per column
    return rated.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "rank", "target", "title", "task", "business_value", "difficulty", "data_quality", (F.col("rank") == 1).alias("recommended"))


def readiness(profile: Profile) -> DataFrame:
    """One row: shape, missing and duplicate share, quality, and the list of issues for modelling."""
    def names(cond) -> Column:
        return F.array_sort(F.collect_list(F.when(cond, F.struct("position", "name"))))

    lists = profile.columns.agg(
        names(F.col("missing_pct") > 30).alias("gaps"), names(F.col("is_probable_id")).alias("ids"),
        names(F.col("semantic_type") == "text").alias("texts"))
    first = lambda c: F.array_join(F.transform(F.slice(c, 1, 3), lambda s: s["name"]), ", ")
    some = lambda c: F.size(c) > 0
    base = profile.summary().join(profile.quality().select("score", "grade"), F.lit(True)).join(lists, F.lit(True))  # one row each
    issues = F.array_compact(F.array(
        F.when(F.col("rows") < 200, "small dataset"),
        F.when(some("gaps"), F.concat(F.lit("missing: "), first("gaps"))),
        F.when(F.col("duplicate_pct") > 1, "duplicates"),
        F.when(some("ids"), F.concat(F.lit("identifiers: "), first("ids"))),
        F.when(some("texts"), F.concat(F.lit("free text: "), first("texts")))))
    cells = F.greatest(F.col("rows") * F.col("columns"), F.lit(1))
    return base.select(
        "rows", "columns", F.round(F.col("total_missing_cells") / cells * 100, 2).alias("missing_pct"), "duplicate_pct",
        F.col("score").alias("quality_score"), F.col("grade").alias("quality_grade"), F.array_join(issues, "; ").alias("issues"))


def advice(board: DataFrame, importance: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(rule, subject, value, verdict) from a leaderboard, feature importances and class sizes."""
    ranked = board.where("error IS NULL")
    lead = ranked.where("rank = 1").select("model", "test_score", "cv_std")
    second = ranked.where("rank = 2").select(F.col("test_score").alias("_s2"))
    margin = F.col("test_score") - F.col("_s2")
    out = [
        lead.join(second, F.lit(True)).select(  # one row each
            F.lit("winner_margin").alias("rule"), F.col("model").alias("subject"), F.round(margin, 4).alias("value"),
            F.when(margin >= 0.02, "clear").otherwise("close").alias("verdict")),
        lead.where("cv_std IS NOT NULL").select(
            F.lit("stability").alias("rule"), F.col("model").alias("subject"), F.col("cv_std").alias("value"),
            F.when(F.col("cv_std") <= 0.02, "stable").when(F.col("cv_std") <= 0.06, "moderate").otherwise("unstable").alias("verdict")),
        importance.where(F.abs("importance") < 1e-4).select(
            F.lit("weak_feature").alias("rule"), F.col("feature").alias("subject"), F.col("importance").alias("value"),
            F.lit("drop candidate").alias("verdict")),
    ]
    if classes is not None:
        size = classes.agg((F.max("n") / F.min("n")).alias("value"), F.min_by("label", "n").cast("string").alias("subject"))
        out.append(size.where("value >= 3").select(
            F.lit("imbalance").alias("rule"), "subject", F.round("value", 4).alias("value"), F.lit("rebalance").alias("verdict")))
    return _stack(out)


def report_tables(profile: Profile) -> dict[str, DataFrame]:
    """The tables of a data report: missing cells, outliers, column statistics, correlations."""
    cols = profile.columns
    return {
        "missing": profile.missing_report(),
        "outliers": cols.where("outliers > 0").select(F.col("name").alias("column"), "outliers", "outlier_pct"),
        "statistics": cols.select("name", "semantic_type", "unique", "missing_pct", "mean", "median", "std", "min", "max"),
        "correlations": profile.top_pairs(),
    }
