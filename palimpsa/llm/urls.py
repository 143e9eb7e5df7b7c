"""URL filter: host and path rules, then a listing behind a blocked Bloom filter with an exact join."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsa.llm.common import settle

WORDS = 8
WORD_BITS = 64
BITS_PER_URL = 16
MAX_BLOCKS = 1 << 17  # 64 bytes each: the filter never exceeds 8 MB, however long the listing is


@dataclass(frozen=True)
class Rule:
    action: str
    place: str

    @property
    def host(self) -> str:
        return self.place.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.place.partition("/")[2]


# Fixed values.
RULES = (
    Rule("allow", "com/"),
    Rule("block", "example.com/en/"),
    Rule("allow", "www.example.com/en/"),
    Rule("block", "net/es/"),
    Rule("block", "net/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: str) -> Column:
    value = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(value, "://")
    return F.when(at > 0, value.substr(at + 3, F.length(value))).otherwise("")


def host_of(url: str) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: str) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """One spelling per page: no ``www.`` or ``m.``, no port, no index page, no closing slash; null without a host."""
    name = F.regexp_replace(F.regexp_replace(host, r":[0-9]*$", ""), r"^(?:www|m)\.", "")
    place = F.regexp_replace(F.regexp_replace(path, r"/index\.html?$", "/"), r"/+$", "")
    return F.when(name != "", F.concat(name, place))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Place and action of the longest rule that fits, else nulls."""
    place = action = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.place)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        place, action = F.when(fits, rule.place).otherwise(place), F.when(fits, rule.action).otherwise(action)
    return place, action


def _block(value: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(blocks))


def _bit(value: Column, word: int) -> Column:
    spread = F.xxhash64(value, F.lit(word // 4))
    return F.shiftright(spread, 16 * (word % 4)).bitwiseAND(F.lit(WORD_BITS - 1)).cast("int")


def bloom_blocks(listing: DataFrame, url: str, blocks: int) -> DataFrame:
    """The filter as rows: a block is eight words, and each listed value sets one bit in each word of its block."""
    value = F.col(url)
    bits = [F.expr(f"shiftleft(1L, _b{i})").alias(f"_w{i}") for i in range(WORDS)]
    placed = listing.select(_block(value, blocks).alias("_block"), *[_bit(value, i).alias(f"_b{i}") for i in range(WORDS)])
    return placed.select("_block", *bits).groupBy("_block").agg(*[F.bit_or(f"_w{i}").alias(f"_w{i}") for i in range(WORDS)])


def judge_urls(
    pages: DataFrame,
    listing: DataFrame,
    rules: Sequence[Rule] = RULES,
    key: str = "page_id",
    url: str = "url",
    max_blocks: int = MAX_BLOCKS,
) -> DataFrame:
    """One row per page row: key, host, path, rule, verdict, listed.

    ``listing`` has one column ``listed_url`` of canonical urls (repeats and nulls are harmless). A page's verdict is
    its longest fitting rule's action; without a rule it is ``block`` if its canonical url is listed, else ``allow``.
    A null url or one without ``://`` has an empty host and path, fits no rule, is not listed and is allowed.
    Repeated pages are judged one by one; an empty listing allows what no rule blocks.

    Possible hits of the blocked Bloom filter are joined exactly with the listing, so false positives go. The filter
    is broadcast: it has at most ``max_blocks`` blocks of 64 bytes. A longer listing only raises the share of pages
    that reach the exact join.
    """
    listed = listing.select(F.col("listed_url").alias("_listed")).filter("_listed is not null").distinct()
    listed = settle(listed, "listing")
    blocks = max(1, min(max_blocks, -(-listed.count() * BITS_PER_URL // (WORDS * WORD_BITS))))
    bloom = F.broadcast(bloom_blocks(listed, "_listed", blocks))
    host, path = host_of(url), path_of(url)
    seen = pages.select(F.col(key).alias("_key"), host.alias("host"), path.alias("path"))
    place, action = rule_of(F.col("host"), F.col("path"), rules)
    seen = seen.select(
        "_key", "host", "path", place.alias("rule"), action.alias("_action"),
        canonical(F.col("host"), F.col("path")).alias("_url"),
    )
    hit = F.lit(True)
    for i in range(WORDS):
        hit = hit & (F.expr(f"shiftright(_w{i}, {'_b%d' % i})").bitwiseAND(F.lit(1).cast("long")) == 1)
    probed = seen.select(
        "*", _block(F.col("_url"), blocks).alias("_block"), *[_bit(F.col("_url"), i).alias(f"_b{i}") for i in range(WORDS)]
    ).join(bloom, "_block", "left")
    probed = probed.select("_key", "host", "path", "rule", "_action", "_url", F.coalesce(hit, F.lit(False)).alias("_maybe"))
    # Only possible hits take part in the exact join; the others never move.
    out = probed.filter("not _maybe").withColumn("listed", F.lit(False))
    sure = (
        probed.filter("_maybe")
        .join(listed, F.col("_url") == F.col("_listed"), "left")
        .withColumn("listed", F.col("_listed").isNotNull())
        .drop("_listed")
    )
    judged = out.unionByName(sure)
    method = F.when(F.col("listed"), "block").otherwise("allow")
    return judged.select(
        F.col("_key").alias(key), "host", "path", "rule", F.coalesce("_action", method).alias("verdict"), "listed"
    )
