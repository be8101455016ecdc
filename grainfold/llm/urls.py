"""URL filter: host and path rules, and a list of whole URLs behind a blocked Bloom filter. SQL functions only.

Canonical URL: host (A-Z lower-cased, a leading ``www.`` and a port 80 or 443
dropped) and path (a trailing ``/`` dropped); scheme, query and fragment are
left out. Listed canonical URLs set 8 bits in one 256-bit block of the filter.
A URL that misses a bit is surely not listed. Those that pass go on to an exact
join with the list, which removes the false positives; copies of a passing URL
are dealt over ``SALTS`` keys, so that one very frequent URL does not meet in
one task.

The filter is a table of at most one row per block. It is broadcast when its
size, known from the count of listed URLs, is below ``BROADCAST_BYTES``, and
joined on salted block numbers otherwise.

Defined cases: a null URL or one without ``://`` has an empty host and path,
fits no rule and is never listed. Null or empty listed URLs are left out, and
copies in the list count once. Repeated rows of pages get a row each. An empty
list or table works. Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainfold.llm.frames import keep_in_folder, pick

BITS_PER_URL, BROADCAST_BYTES, SALTS = 12, 64 << 20, 16
_LANES = 4  # 64-bit words of a block; two bits are set in each


@dataclass(frozen=True)
class HostRule:
    """``verdict`` for a host, its subdomains and every path that starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    rest = F.expr("substring(url, instr(url, '://') + 3)")
    return F.when(url.contains("://"), _lower(F.regexp_extract(rest, "^([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.expr("substring(url, instr(url, '://') + 3)")
    return F.when(url.contains("://"), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def canonical(host: Column, path: Column) -> Column:
    """The key under which a URL is listed; null for an empty host."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), ":(80|443)$", "")
    return F.when(host != "", F.concat(bare, F.lit("/"), F.regexp_replace(path, "^/+|/+$", "")))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _lane(key: Column, lane: int) -> Column:
    """Two bits of one 64-bit word, from six bits each of a second hash."""
    h = F.xxhash64(key, F.lit(7))
    bit = lambda i: F.shiftrightunsigned(h, 6 * (2 * lane + i)).bitwiseAND(63)
    one = F.lit(1).cast("long")
    return F.call_function("shiftleft", one, bit(0).cast("int")).bitwiseOR(F.call_function("shiftleft", one, bit(1).cast("int")))


def bloom(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter as a table: block number and its 64-bit words, for all blocks that hold a URL."""
    return listed.groupBy(_block(F.col(key), blocks).alias("block")).agg(*[F.bit_or(_lane(F.col(key), i)).alias(f"w{i}") for i in range(_LANES)])


def listed_rows(urls: DataFrame, key: str, listed: DataFrame, listed_key: str) -> DataFrame:
    """``urls`` with a last column ``listed``: whether the key is in the list, decided exactly."""
    known = keep_in_folder(listed.select(F.col(listed_key).alias("known")).where("known is not null").distinct(), "url-list")
    count = known.count()
    blocks = max(1, -(-count * BITS_PER_URL // (64 * _LANES)))
    words = bloom(known, "known", blocks)
    probe = urls.withColumn("block", _block(F.col(key), blocks))
    if blocks * 8 * (_LANES + 1) <= BROADCAST_BYTES:
        probe = probe.join(F.broadcast(words), "block", "left")
    else:
        salted = words.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        probe = probe.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, ["block", "salt"], "left").drop("salt")
    may = F.lit(True)
    for i in range(_LANES):
        bits = _lane(F.col(key), i)
        may = may & F.coalesce(F.col(f"w{i}").bitwiseAND(bits) == bits, F.lit(False))
    probe = probe.withColumn("may", F.coalesce(may, F.lit(False))).drop("block", *[f"w{i}" for i in range(_LANES)])
    # Only URLs that may be listed carry a key into the exact join. The others stay apart by a random salt and meet nothing.
    exact = known.select(F.xxhash64("known").alias("hash"), "known", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    passed = probe.where("may").withColumn("hash", F.xxhash64(key)).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    met = passed.join(exact, (passed["hash"] == exact["hash"]) & (passed["salt"] == exact["salt"]) & (passed[key] == exact["known"]), "left")
    decided = met.select(*urls.columns, F.col("known").isNotNull().alias("listed"))
    return decided.unionByName(probe.where("NOT may").select(*urls.columns, F.lit(False).alias("listed")))


def judge(pages: DataFrame, listed: DataFrame, rules: tuple[HostRule, ...], *, page_id: str = "page_id", url: str = "url", listed_url: str = "url") -> DataFrame:
    """Per page: page_id, host, path, rule (the longest that fits, or null), listed and verdict.

    The rule decides where one fits; else a listed URL is blocked and any other allowed.
    """
    pages = pick(pages, page_id=page_id, url=url)
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    of = pick(listed, url=listed_url).select(canonical(host_of(F.col("url")), path_of(F.col("url"))).alias("key"))
    judged = judged.withColumn("key", canonical(F.col("host"), F.col("path")))
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("listed"), "block").otherwise("allow")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is asked first
        rule = F.when(r.fits(F.col("host"), F.col("path")), F.lit(r.text)).otherwise(rule)
        verdict = F.when(r.fits(F.col("host"), F.col("path")), F.lit(r.verdict)).otherwise(verdict)
    return listed_rows(judged, "key", of, "key").select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "listed")
