"""Quality rules as a short-circuit cascade, in SQL functions only.

Each rule is an SQL condition under which a text is rejected. The cascade runs
the rules one after the other and stops at the first that rejects. Their order
is set by a sample: every rule's running time and share of rejections are
measured there, and the rule with most rejections per second comes first. The
order changes the cost only; which texts are kept does not depend on it.

Base measures of a text (words are runs of characters other than blanks and the
control characters 9 to 13): n_words, word_chars, n_symbols, n_dup_lines,
n_lines, n_repeat_words. All work stays inside one row, so no text is shuffled.

Defined cases: a null or empty text has no words and all measures 0, so the
rule for short texts rejects it. Repeated rows get a row each. An empty table
gives an empty result; its rules keep the order given. Other columns are not
looked at.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainfold.llm.frames import discard, keep_in_folder, pick, quoted

SAMPLE_ROWS = 2_000  # rows on which cost and selectivity of the rules are measured
WINDOW = 8
_BLANK, _NOT_BLANK = r"[\\x20\\x09-\\x0D]", r"[^\\x20\\x09-\\x0D]"


def let(value: str, name: str, body: str) -> str:
    """SQL that computes ``value`` once and uses it under a name."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def words_sql(text: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), '{_NOT_BLANK}+', 0)"


def repeat_words_sql(words: str, size: int = WINDOW) -> str:
    """Words covered by windows of ``size`` words that occur at least twice in an array of words."""
    n = f"size(ws) - {size - 1}"
    hashes = let(f"transform({words}, w -> xxhash64(w))", "ws", f"IF({n} < 2, cast(array() as array<bigint>), transform(sequence(1, {n}), i -> xxhash64(slice(ws, i, {size}))))")
    again = "(j > 0 AND s[j].h = s[j - 1].h) OR (j < size(s) - 1 AND s[j].h = s[j + 1].h)"
    places = let("array_sort(transform(hs, (h, i) -> struct(h AS h, i AS i)))", "s", f"array_sort(transform(filter(sequence(0, size(s) - 1), j -> {again}), j -> s[j].i))")
    covered = let(places, "p", f"aggregate(sequence(1, size(p)), 0L, (n, j) -> n + IF(j = size(p), {size}, least({size}, element_at(p, IF(j = size(p), j, j + 1)) - element_at(p, j))))")
    return let(hashes, "hs", f"IF(size(array_distinct(hs)) = size(hs), 0L, {covered})")


@dataclass(frozen=True)
class Rule:
    """A text is rejected where ``rejects`` (SQL over the measures and ``text``) holds; null does not reject."""

    name: str
    rejects: str


BASE_RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
)
RULES = (
    Rule("symbols", "5 * n_symbols > n_words"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("repeated_lines", rf"2 * n_dup_lines > size(filter(split(coalesce(text, ''), '\\n', -1), x -> x RLIKE '{_NOT_BLANK}'))"),
    Rule("words_without_letters", r"10 * regexp_count(coalesce(text, ''), '(?<![^\\x20\\x09-\\x0D])[^\\x20\\x09-\\x0DA-Za-z\\x{80}-\\x{10FFFF}]+(?![^\\x20\\x09-\\x0D])') > 4 * n_words"),
)


def measure(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", carry_text: bool = False) -> DataFrame:
    """doc_id and the base measures (and the text, if asked for)."""
    lines = let(rf"filter(split(coalesce(text, ''), '\\n', -1), x -> x RLIKE '{_NOT_BLANK}')", "ls", "size(ls) - size(array_distinct(ls))")
    parts = let(words_sql("text"), "ws0", f"struct(size(ws0) AS n, length(array_join(ws0, '')) AS chars, {repeat_words_sql('ws0')} AS again)")
    return pick(docs, doc_id=doc_id, text=text).select(
        "doc_id", "text", F.expr(parts).alias("m"),
        F.expr("regexp_count(coalesce(text, ''), '[#*$%&|<>]')").cast("long").alias("n_symbols"), F.expr(lines).cast("long").alias("n_dup_lines"),
    ).select(
        "doc_id", *(["text"] if carry_text else []), F.col("m.n").cast("long").alias("n_words"), F.col("m.chars").cast("long").alias("word_chars"),
        "n_symbols", "n_dup_lines", F.col("m.again").cast("long").alias("n_repeat_words"))


def _prepared(rows: DataFrame) -> DataFrame:
    """The rows with their words and the cheap counts. The number in ``_row`` keeps a filter above from being planned below,
    where it would work the counts out again for each mention."""
    lines = let(rf"filter(split(coalesce(text, ''), '\\n', -1), x -> x RLIKE '{_NOT_BLANK}')", "ls", "size(ls) - size(array_distinct(ls))")
    held = rows.select("*", F.expr(words_sql("text")).alias("ws"), F.expr("regexp_count(coalesce(text, ''), '[#*$%&|<>]')").alias("n_symbols"),
                       F.expr(lines).alias("n_dup_lines"), F.monotonically_increasing_id().alias("_row"))
    return held.select("*", F.size("ws").alias("n_words"), F.length(F.array_join("ws", "")).alias("word_chars"))


def _lazily(rule: Rule) -> Rule:
    """The rule over prepared rows: the windows are worked out where it is reached only."""
    return Rule(rule.name, re.sub(r"\bn_repeat_words\b", lambda _: f"({repeat_words_sql('ws')})", rule.rejects))


def order_rules(texts: DataFrame, rules: tuple[Rule, ...], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by falling rejections per second on a random sample of about ``sample_rows`` texts. It sets the order only."""
    there = texts.count()
    sample = keep_in_folder(texts.select("text").sample(min(1.0, sample_rows / max(there, 1)), seed=7), "quality-sample")
    ready, lazy = _prepared(sample), {r.name: F.expr(_lazily(r).rejects) for r in rules}
    rejected = ready.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(n) for n, c in lazy.items()]).first()
    if not rejected["n"]:
        discard(sample)
        return list(rules)

    def seconds(*condition: Column) -> float:
        taken = []
        for _ in range(2):
            begin = time.perf_counter()
            ready.agg(F.sum("n_words"), F.sum("word_chars"), F.sum("n_symbols"), F.sum("n_dup_lines"), *[F.count_if(c) for c in condition]).first()
            taken.append(time.perf_counter() - begin)
        return min(taken)

    empty = seconds()
    cost = {n: max(seconds(c) - empty, 1e-3) for n, c in lazy.items()}
    discard(sample)
    return sorted(rules, key=lambda r: -rejected[r.name] / cost[r.name])


def first_rejecting(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, evaluated one after the other; null if none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(F.expr(rule.rejects), F.lit(rule.name)).otherwise(out)
    return out


def judge(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES,
          base_rules: tuple[Rule, ...] = BASE_RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per document: doc_id, the base measures, base_failed, rejected_by (the rule that stopped the cascade) and kept."""
    measured = measure(docs, doc_id=doc_id, text=text, carry_text=True)
    ordered = order_rules(pick(docs, text=text), rules, sample_rows)
    base = F.expr(" OR ".join(f"({r.rejects})" for r in base_rules) or "false")
    return (
        measured.withColumn("base_failed", base)
        .withColumn("rejected_by", F.when(F.col("base_failed"), first_rejecting(list(base_rules))).otherwise(first_rejecting(ordered)))
        .withColumn("kept", F.col("rejected_by").isNull())
        .drop("text")
    )


def keep_good(docs: DataFrame, *, text: str = "text", rules: tuple[Rule, ...] = RULES, base_rules: tuple[Rule, ...] = BASE_RULES,
              sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that no rule rejects, with all their columns.

    The words and the cheap counts are made for every text, the windows only where the cascade comes to their rule.
    """
    ordered = [_lazily(r) for r in order_rules(pick(docs, text=text), tuple(base_rules) + tuple(rules), sample_rows)]
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), F.col(quoted(text)).alias("text"))
    return _prepared(rows).where((F.col("_row") >= 0) & first_rejecting(ordered).isNull()).select("row.*")
