"""Findings: invisible characters and user keywords, with exact positions."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import groupby

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsa.functions import chars, patterns
from palimpsa.functions.arrays import sql_literal
from palimpsa.functions.automaton import find_keywords
from palimpsa.functions.scan import find_all, find_all_deep

# Limits on user-supplied keywords and patterns.
MAX_KEYWORDS = 100
MAX_KEYWORD_CHARS = 300
MAX_PATTERN_CHARS = 200
MAX_PATTERN_GROUPS = 20

# From so many literal keywords on, one pass of an automaton is cheaper than a pass for each.
AUTOMATON_KEYWORDS = 8

# Fixed value: shapes that backtrack without bound: a repeated group whose body ends in a
# repeat, the same with an open count, and three wildcards in a row.
RISKY_SHAPE = r"\([^()]*[+*]\)(?:[+*]|\{\p{Nd}*,)|(?:\.[+*]){3,}"

FINDING_TYPE = (
    "array<struct<kind:string,kw_ord:int,id:string,codepoint:string,name:string,"
    "matched_text:string,keyword:string,position:int,line:int,column:int>>"
)


@dataclass(frozen=True)
class DetectionConfig:
    """What to look for; blank keywords are ignored."""

    keywords: list[str] = field(default_factory=list)
    use_regex: bool = False
    case_sensitive: bool = False
    detect_invisible: bool = True
    max_keywords: int = MAX_KEYWORDS
    max_keyword_chars: int = MAX_KEYWORD_CHARS

    def __post_init__(self) -> None:
        if len(self.keywords) > self.max_keywords:
            raise ValueError(f"at most {self.max_keywords} keywords")
        if any(len(k) > self.max_keyword_chars for k in self.keywords):
            raise ValueError(f"a keyword may hold at most {self.max_keyword_chars} characters")


def is_risky_pattern(pattern: Column) -> Column:
    """True where a pattern should not be run at all."""
    return (
        (F.length(pattern) > MAX_PATTERN_CHARS)
        | (F.length(pattern) - F.length(F.replace(pattern, F.lit("("), F.lit(""))) > MAX_PATTERN_GROUPS)
        | pattern.rlike(RISKY_SHAPE)
    )


def _compiles(spark: SparkSession, pattern: str) -> bool:
    """Ask the engine's own compiler, on the driver; a bad pattern in the real query would fail the job."""
    try:
        re.compile(pattern)
        if not patterns.is_deep(pattern):
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(patterns.anywhere(pattern))
        return True
    except (re.error, Py4JJavaError):
        return False


def vet_patterns(spark: SparkSession, keywords: list[str]) -> tuple[list[str], list[tuple[str, str]]]:
    """Usable patterns, and (pattern, reason) for those that are set aside.

    Works on the job's configuration, never on data: one small job for the shapes, no job per pattern.
    """
    if not keywords:
        return [], []
    listed = spark.createDataFrame([(i, k) for i, k in enumerate(keywords)], "i int, k string")
    risky = {r["i"] for r in listed.filter(is_risky_pattern(F.col("k"))).collect()}
    usable, rejected = [], []
    for i, keyword in enumerate(keywords):
        if i in risky:
            rejected.append((keyword, "unsafe"))
        elif not _compiles(spark, keyword):
            rejected.append((keyword, "invalid"))
        else:
            usable.append(keyword)
    return usable, rejected


def rejected_keywords(spark: SparkSession, config: DetectionConfig) -> Column:
    """Constant array of (keyword, reason) for patterns that do not run, so that no text passes as clean for them."""
    stripped = [k.strip() for k in config.keywords if k.strip()]
    rejected = vet_patterns(spark, stripped)[1] if config.use_regex else []
    entries = ", ".join(f"struct({sql_literal(k)} as keyword, {sql_literal(r)} as reason)" for k, r in rejected)
    return F.expr(f"cast(array({entries}) as array<struct<keyword:string,reason:string>>)")


def invisible_findings(text: Column) -> Column:
    """Flagged characters in text order."""
    return F.transform(
        find_all(text, chars.FLAGGED_CLASS),
        lambda m: F.struct(
            F.lit("invisible").alias("kind"),
            F.lit(0).alias("kw_ord"),
            F.concat(F.lit("inv:"), m["position"]).alias("id"),
            chars.code_point_label(m["matched"]).alias("codepoint"),
            chars.char_name(m["matched"]).alias("name"),
            m["matched"].alias("matched_text"),
            F.lit(None).cast("string").alias("keyword"),
            m["position"].alias("position"),
            m["line"].alias("line"),
            m["column"].alias("column"),
        ),
    )


def keyword_pattern(keyword: str, config: DetectionConfig) -> str:
    body = patterns.anywhere(keyword) if config.use_regex else patterns.quote(keyword)
    return patterns.flags(config.case_sensitive) + body


def keyword_list(keywords: list[tuple[int, str]], config: DetectionConfig) -> Column:
    """Constant array of struct<ordinal, keyword, pattern>.

    The keywords are walked inside the row, so the plan stays the same size for
    any number of them; compiling a pattern costs little next to reading a text.
    """
    entries = ", ".join(
        f"struct({i} as ordinal, {sql_literal(k)} as keyword, {sql_literal(keyword_pattern(k, config))} as pattern)"
        for i, k in keywords
    )
    return F.expr(f"array({entries})")


def _any_keyword(keywords: list[tuple[int, str]], config: DetectionConfig) -> str | None:
    """One pattern that is found wherever one of the keywords is; none if groups would get other numbers or names."""
    if config.use_regex and any(re.search(r"\\[1-9]|\(\?P|\(\?[a-zA-Z]", k) for _, k in keywords):
        return None
    bodies = [patterns.anywhere(k) if config.use_regex else patterns.quote(k) for _, k in keywords]
    return patterns.flags(config.case_sensitive) + "|".join(f"(?:{b})" for b in bodies)


def each_keyword(text: Column, keywords: list[str], config: DetectionConfig, report: Callable) -> Column:
    """``report(ordinal, keyword, matches)`` of every keyword, one after another, in one array.

    Neighbouring keywords are walked together, and only in texts that hold any of them. Patterns that the JVM's matcher
    cannot run on long texts go through Python instead, and so do many literal keywords, all in one pass of the text:
    the plan and the passes are the same for ten thousand.
    """
    numbered = list(enumerate(keywords, start=1))
    if not config.use_regex and len(keywords) >= AUTOMATON_KEYWORDS:
        found = find_keywords(text, numbered, config.case_sensitive)
        return F.flatten(F.transform(found, lambda g: report(g["ordinal"], g["keyword"], g["matches"])))
    parts = []
    for deep, run in groupby(numbered, lambda k: config.use_regex and patterns.is_deep(k[1])):
        run = list(run)
        if deep:
            parts += [report(F.lit(i), F.lit(k), find_all_deep(text, k, config.case_sensitive)) for i, k in run]
            continue
        walk = lambda k: report(k["ordinal"], k["keyword"], find_all(text, k["pattern"]))
        found = F.flatten(F.transform(keyword_list(run, config), walk))
        some = _any_keyword(run, config)
        parts.append(found if some is None else F.when(text.rlike(some), found).otherwise(F.array()))
    return F.concat(*parts)


def keyword_findings(text: Column, keywords: list[str], config: DetectionConfig) -> Column:
    """Matches keyword by keyword, each in text order."""

    def one(ordinal: Column, keyword: Column, matches: Column) -> Column:
        return F.transform(
            matches,
            lambda m: F.struct(
                F.lit("keyword").alias("kind"),
                ordinal.alias("kw_ord"),
                F.concat_ws(":", F.lit("kw"), m["position"], m["position"] + F.length(m["matched"])).alias("id"),
                F.lit(None).cast("string").alias("codepoint"),
                F.lit(None).cast("string").alias("name"),
                m["matched"].alias("matched_text"),
                keyword.alias("keyword"),
                m["position"].alias("position"),
                m["line"].alias("line"),
                m["column"].alias("column"),
            ),
        )

    return each_keyword(text, keywords, config, one)


def usable_keywords(spark: SparkSession, config: DetectionConfig) -> list[str]:
    stripped = [k.strip() for k in config.keywords if k.strip()]
    return vet_patterns(spark, stripped)[0] if config.use_regex else stripped


def findings(spark: SparkSession, text: Column, config: DetectionConfig) -> Column:
    """All findings of a text as one array: invisible ones first, then keyword by keyword."""
    text = F.coalesce(text, F.lit(""))
    parts = [invisible_findings(text)] if config.detect_invisible else []
    keywords = usable_keywords(spark, config)
    if keywords:
        parts.append(keyword_findings(text, keywords, config))
    if not parts:
        return F.array().cast(FINDING_TYPE)
    return F.concat(*parts)


def add_findings(documents: DataFrame, config: DetectionConfig) -> DataFrame:
    """Documents with a ``findings`` array; a narrow projection."""
    return documents.withColumn("findings", findings(documents.sparkSession, F.col("text"), config))


def rows_of(frame: DataFrame, keep: tuple[str, ...], column: str, ordinal: str | None = None) -> DataFrame:
    """One row per struct of an array column.

    The outer form is used because the plain one makes the optimizer add a
    size filter below the projection, which computes the array a second time.
    """
    if ordinal is None:
        opened = frame.select(*keep, F.explode_outer(column).alias("_row"))
        return opened.filter(F.col("_row").isNotNull()).select(*keep, "_row.*")
    opened = frame.select(*keep, F.posexplode_outer(column).alias(ordinal, "_row"))
    return opened.filter(F.col("_row").isNotNull()).select(*keep, ordinal, "_row.*")


def findings_table(documents: DataFrame, config: DetectionConfig, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per finding."""
    found = documents.select(*keep, findings(documents.sparkSession, F.col("text"), config).alias("findings"))
    return rows_of(found, keep, "findings")


def count_kind(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda f: f["kind"] == kind))
