"""Conversation tables: intent tags, spelling repair, previous user turn."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainfold.functions.columns import ref
from grainfold.operators import ordering

# Patterns that decide the intent of a message; the first match counts.
INTENTS = (
    ("app_help", r"where is|where's|where can i find|which tab|which page|which menu|"
                 r"how do i (open|use|get to|navigate|find|access)|how to (open|use|find|access)|"
                 r"take me to|navigate to|what does the .* (tab|page|button) do|explain the .* (tab|page)"),
    ("sql", r"\bsql\b|\bquery\b"),
    ("python", r"\bpython\b|\bpandas\b|\bcode\b|\bscript\b"),
    ("missing", r"missing|null|nan|empty|incomplete"),
    ("correlation", r"correlat|relationship|related|associat|driver"),
    ("distribution", r"distribut|spread|histogram|range of"),
    ("trend", r"trend|over time|by month|by year|time series|forecast|growth"),
    ("diagnose", r"why|declin|drop|decrease|increase|diagnos|root cause|accuracy is low|low accuracy"),
    ("feature_engineering", r"feature engineer|new feature|create.*feature|derive.*feature|feature idea|"
                            r"engineer.*feature|feature to (add|create)"),
    ("cleaning", r"\bclean\b|cleanse|cleaning|preprocess|prepare the data|wrangl|tidy|fix the data|prep the data"),
    ("recommend_model", r"which model|what model|recommend.*model|best model|predict|classif|regress"),
    ("explain_stat", r"explain|meaning of|definition of|interpret|how do i read|what does .* mean|what is a |what is an "),
    ("top_n", r"\btop\b|best|highest|largest|biggest|most|ranking|rank|leading|worst|lowest|smallest|least"),
    ("aggregate", r"average|avg|mean|sum|total|count|how many|how much|per |by "),
    ("describe", r"describe|summary|summarise|summarize|overview|profile|statistics|stats|tell me about"),
)
# Fixed value: words that point back to an earlier turn.
FOLLOW_UP = (r"\b(them|they|it|its|that|those|these|this one|the same|the model|"
             r"the result|the results|the chart|the plot|the feature)\b")

# Words of the domain that a token may be repaired to.
DOMAIN_WORDS = {
    "revenue": ("revenue", "revenues", "rev", "turnover", "income", "earnings"),
    "sales": ("sales", "sale", "sold", "selling", "sell"),
    "amount": ("amount", "amt", "value", "total", "spend", "spending"),
    "profit": ("profit", "margin", "profits", "earnings"),
    "price": ("price", "prices", "cost", "unitprice"),
    "quantity": ("quantity", "qty", "units", "count", "volume"),
    "customer": ("customer", "customers", "client", "clients", "buyer", "user", "users"),
    "product": ("product", "products", "item", "items", "sku", "goods"),
    "region": ("region", "regions", "area", "territory", "location", "geo"),
    "category": ("category", "categories", "segment", "segments", "type", "group"),
    "date": ("date", "day", "time", "period", "month", "year", "timestamp"),
    "order": ("order", "orders", "transaction", "transactions", "purchase"),
}
# Words that are never repaired.
STOP_WORDS = (
    "the", "a", "an", "of", "for", "to", "in", "on", "by", "and", "or", "is",
    "are", "what", "which", "show", "me", "my", "give", "list", "top", "best",
    "highest", "lowest", "most", "least", "biggest", "largest", "smallest",
    "how", "many", "much", "average", "avg", "mean", "sum", "total", "count",
    "per", "each", "group", "with", "that", "this", "it", "do", "does", "can",
    "you", "please", "about", "from", "get", "find", "all", "any",
)
# The similarity from which a word is repaired, and what a word is.
SIMILARITY = 0.82
_TOKEN = r"[A-Za-z][A-Za-z0-9_]*"


def intent(text: Column) -> Column:
    """Intent tag of a message; ``general`` when no pattern matches."""
    low = F.lower(text)
    tag = F.lit("general")
    for name, pattern in reversed(INTENTS):
        tag = F.when(low.rlike(pattern), name).otherwise(tag)
    return tag


def tag_intents(turns: DataFrame, text: str = "text") -> DataFrame:
    return turns.withColumn("intent", intent(ref(text)))


def previous_user_turn(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Text of the latest earlier user turn of the same conversation, as ``previous``."""
    marked = turns.withColumn("previous", F.when(ref(role) == "user", ref(text)))
    return ordering.carry(marked, ["previous"], [order], [key], include_current=False)


def resolve_follow_ups(turns: DataFrame) -> DataFrame:
    """Intent of each turn, taken from the previous user turn when the text only points back."""
    held = previous_user_turn(turns)
    own, before = intent(F.col("text")), intent(F.col("previous"))
    points_back = F.col("previous").isNotNull() & F.lower("text").rlike(FOLLOW_UP)
    return held.withColumn("follow_up", points_back).withColumn(
        "intent", F.when(points_back & (own == "general"), before).otherwise(own))


def vocabulary(columns: Sequence[str] = ()) -> list[str]:
    words = {w for k, forms in DOMAIN_WORDS.items() for w in (k, *forms)}
    words |= {t for c in columns for t in re.findall(_TOKEN, c.lower()) if len(t) >= 3}
    return sorted(words)


# A word and its repair have a common subsequence of at least SIMILARITY / 2 of their letters together, so both become the same string
# when some letters are deleted. Words of up to SHORT letters are found by all those strings; the deletions of longer ones would be
# too many, but at most a bounded number of letters lies between them, so one of a few pieces of the word stands whole in the token.
SHORT = 14
_HALF = SIMILARITY / 2


def _common(letters: Column) -> Column:
    """The least common letters of two words with so many letters together."""
    return F.ceil(letters * _HALF - 1e-9).cast("int")


def _deletions(word: Column) -> Column:
    """A word and what is left of it when letters are deleted, as many as a repair can need."""
    n = F.length(word)
    fewer = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, n)))
    # the other word may consist of the common letters alone
    most = F.floor(n * (1 - _HALF / (1 - _HALF)) + 1e-9).cast("int")
    rounds = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, F.array(word), lambda found, _: F.array_distinct(F.concat(found, F.flatten(F.transform(found, fewer)))))


def _pieces(word: Column, length: Column) -> Column:
    """(number, start, piece): the word of ``length`` letters cut into one piece more than letters can differ from a token."""
    widest = F.floor(length * ((1 - _HALF) / _HALF) + 1e-9).cast("int")  # letters of the longest token
    count = F.least(length, length + widest - 2 * _common(length + widest) + 2)  # the number goes up and down by one with the letters
    cut = lambda i: F.floor(i * length / count).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(
        i.alias("number"), (cut(i) + 1).alias("start"), F.substring(word, cut(i) + 1, cut(i + 1) - cut(i)).alias("piece")))


def spelling_candidates(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(token, word): all pairs that can be similar enough, each once, by equality of strings; ``tokens`` (token), ``words`` (word)."""
    length = F.length
    left = tokens.where(length("token") <= SHORT).select("token", F.explode(_deletions(F.col("token"))).alias("_s"))
    right = words.where(length("word") <= SHORT).select("word", F.explode(_deletions(F.col("word"))).alias("_s"))
    short = left.join(right, "_s").where(length("_s") >= _common(length("token") + length("word"))).select("token", "word")
    least = int((SHORT + 1) * _HALF / (1 - _HALF))  # letters of a word that a longer one can be similar to
    index = words.where(length("word") >= least).select("word", length("word").alias("_n"), F.explode(_pieces(F.col("word"), length("word"))).alias("_p"))
    index = index.select("word", "_n", "_p.number", "_p.piece")
    n = length("token")
    asked = tokens.where(n >= least).select("token", F.explode(F.sequence(F.ceil(n * (_HALF / (1 - _HALF)) - 1e-9).cast("int"), F.floor(n * ((1 - _HALF) / _HALF) + 1e-9).cast("int"))).alias("_n"))
    asked = asked.where(F.greatest(n, F.col("_n")) > SHORT).withColumn("_d", n + F.col("_n") - 2 * _common(n + F.col("_n")))
    # the pieces of any word of that length stand at the same places; in the token they may be shifted
    shape = asked.withColumn("_ps", _pieces(F.repeat(F.lit("-"), F.col("_n")), F.col("_n")))
    # a letter that differs spoils one piece at most: the others stand whole
    places = shape.select("token", "_n", "_d", F.greatest(F.lit(1), F.size("_ps") - F.col("_d")).alias("_need"), F.explode("_ps").alias("_p"))
    start = F.explode(F.sequence(F.greatest(F.lit(1), F.col("_p.start") - F.col("_d")), F.greatest(F.lit(1), F.col("_p.start") + F.col("_d"))))
    places = places.select("token", "_n", "_need", F.col("_p.number").alias("number"), F.length("_p.piece").alias("_l"), start.alias("_at"))
    places = places.where(F.col("_at") + F.col("_l") - 1 <= n).select("token", "_n", "_need", "number", F.substring("token", F.col("_at"), F.col("_l")).alias("piece")).distinct()
    whole = places.join(index, ["_n", "number", "piece"]).groupBy("token", "word", "_need").agg(F.count_distinct("number").alias("_whole"))
    return short.unionByName(whole.where("_whole >= _need").select("token", "word")).distinct()


def spelling_table(texts: DataFrame, text: str, words: Sequence[str] | DataFrame) -> DataFrame:
    """(token, target): unknown tokens of a text column and the word each should become.

    Every distinct token is looked up once, whatever the number of texts, and
    meets only the words that an index of strings brings to it, whatever the
    number of words. Of these the most similar counts, of equals the greater one.
    """
    if not isinstance(words, DataFrame):
        words = texts.sparkSession.createDataFrame([(w,) for w in words], "word string")
    known = words.select(F.col(words.columns[0]).alias("word")).where("word IS NOT NULL").distinct()
    tokens = (
        texts.select(F.explode(F.regexp_extract_all(F.lower(ref(text)), F.lit(f"({_TOKEN})"), F.lit(0))).alias("token"))
        .where((F.length("token") >= 4) & ~F.col("token").isin(*STOP_WORDS)).distinct()
    )
    unknown = tokens.join(known, F.col("token") == F.col("word"), "left_anti")

    def ratios(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(ratio=[difflib.SequenceMatcher(None, w, t).ratio() for t, w in zip(batch["token"], batch["word"])])

    measured = spelling_candidates(unknown, known).mapInPandas(ratios, "token string, word string, ratio double")
    return measured.where(F.col("ratio") >= SIMILARITY).groupBy("token").agg(F.max_by("word", F.struct("ratio", "word")).alias("target"))


def correct_spelling(texts: DataFrame, key: str, text: str, columns: Sequence[str] = ()) -> DataFrame:
    """(key, corrected): texts with misspelt domain words and column names repaired.

    Texts are cut into tokens and gaps, the tokens are joined to the repair
    table, and each text is put together again in its order.
    """
    pieces = texts.select(
        ref(key).alias("_k"),
        F.posexplode(F.regexp_extract_all(ref(text), F.lit(rf"({_TOKEN}|[^A-Za-z]+)"), F.lit(0))).alias("_i", "_p"))
    fixes = spelling_table(texts, text, vocabulary(columns))
    joined = pieces.join(fixes, F.lower("_p") == F.col("token"), "left")
    upper = F.substring("_p", 1, 1).rlike("[A-Z]")
    piece = F.when(F.col("target").isNull(), F.col("_p")).when(upper, F.initcap("target")).otherwise(F.col("target"))
    parts = joined.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_i", piece.alias("t")))).alias("_a"))
    built = parts.select("_k", F.array_join(F.transform("_a", lambda s: s["t"]), "").alias("corrected"))
    return texts.select(ref(key), ref(text).alias("_text")).join(built, ref(key) == F.col("_k"), "left").select(
        ref(key), F.when(F.col("_text").isNotNull(), F.coalesce("corrected", F.lit(""))).alias("corrected"))
