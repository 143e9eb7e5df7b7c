"""Comments in source code: language, extraction, and audits of the code/comment partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsa.functions.arrays import array_total, literal_map
from palimpsa.functions.patterns import quote, to_java
from palimpsa.functions.scan import find_all
from palimpsa.functions.texts import strip
from palimpsa.operators.detect import rows_of

# Line marker, block start and block end by language.
SYNTAX: dict[str, tuple[str | None, str | None, str | None]] = {
    "python": ("#", None, None),
    "ruby": ("#", None, None),
    "shell": ("#", None, None),
    "yaml": ("#", None, None),
    "javascript": ("//", "/*", "*/"),
    "typescript": ("//", "/*", "*/"),
    "java": ("//", "/*", "*/"),
    "c": ("//", "/*", "*/"),
    "cpp": ("//", "/*", "*/"),
    "csharp": ("//", "/*", "*/"),
    "go": ("//", "/*", "*/"),
    "php": ("//", "/*", "*/"),
    "rust": ("//", "/*", "*/"),
    "swift": ("//", "/*", "*/"),
    "kotlin": ("//", "/*", "*/"),
    "css": (None, "/*", "*/"),
    "sql": ("--", "/*", "*/"),
    "html": (None, "<!--", "-->"),
    "xml": (None, "<!--", "-->"),
}
DEFAULT_SYNTAX = ("//", "/*", "*/")

# Language by file suffix.
EXTENSIONS = {
    "py": "python", "rb": "ruby", "sh": "shell", "bash": "shell", "yml": "yaml", "yaml": "yaml",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "typescript",
    "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp",
    "cs": "csharp", "go": "go", "php": "php", "rs": "rust", "swift": "swift", "kt": "kotlin",
    "css": "css", "scss": "css", "sql": "sql", "html": "html", "htm": "html", "xml": "xml",
}

# Formal ways to open a comment.
FORMAL_OPENERS = [
    "esta función se encarga de",
    "este método se encarga de",
    "esta clase se encarga de",
    "esta función",
    "este método",
    "nota importante:",
    "nota:",
    "observación:",
    "importante:",
    "atención:",
    "this function is responsible for",
    "this method is responsible for",
    "note:",
    "important:",
]

COMMENT_TYPE = "array<struct<kind:string,line:int,body:string>>"


# Marks of languages, tried in this order. A language fits when one of its groups fits, a group when
# all of its patterns (with their flags) are found.
MARKS = [
    ("python", [[(r"^\s*#!.*python", "")], [(r"\bdef \w+\(.*\):", "")], [(r"^\s*(?:import|from)\s+\w+", "m")]]),
    ("php", [[(r"<\?php", "")]]),
    ("html", [[(r"<!DOCTYPE html>|<html[\s>]", "iu")]]),
    ("java", [[(r"public class", "")], [(r"^\s*package\s+[\w.]+;", "m")]]),
    ("rust", [[(r"\bfn \w+\(", ""), (r"->", "")]]),
    ("go", [[(r"^\s*package\s+\w+", "m"), (r"\bfunc \w+\(", "")]]),
    ("sql", [[(r"\b(?:SELECT|INSERT INTO|UPDATE|DELETE FROM)\b", "iu")]]),
]
UNMARKED = "javascript"


def sniff_language(code: Column, head_chars: int | None = None) -> Column:
    """The first language with a mark in the code, or in its first ``head_chars`` characters if that is given."""
    head = code if head_chars is None else F.substring(code, 1, head_chars)
    out = F.lit(UNMARKED)
    for language, groups in reversed(MARKS):
        found = F.lit(False)
        for group in groups:
            whole = F.lit(True)
            for pattern, flags in group:
                whole = whole & head.rlike(f"(?d{flags})" + to_java(pattern))
            found = found | whole
        out = F.when(found, language).otherwise(out)
    return out


def resolve_language(code: Column, filename: Column | None = None, language: Column | None = None) -> Column:
    """A known explicit name, else the suffix, else the content."""
    options = []
    if language is not None:
        named = F.lower(language)
        options.append(F.when(named.isin(*SYNTAX), named))
    if filename is not None:
        suffix = F.when(F.contains(filename, F.lit(".")), F.lower(F.substring_index(filename, ".", -1)))
        options.append(F.try_element_at(literal_map(EXTENSIONS.items()), suffix))
    return F.coalesce(*options, sniff_language(code))


def token_pattern(line: str | None, start: str | None, end: str | None) -> str:
    """Strings (reset at each line), line comments, and block comments with the unscanned rest of their last line.

    Possessive repeats keep the matcher's stack flat on long strings.
    """
    parts = [rf"{q}[^{q}\\\n]*+(?:\\[^\n]?[^{q}\\\n]*+)*+{q}?" for q in ("'", '"', "`")]
    if line:
        parts.append(quote(line) + r"[^\n]*+")
    if start and end:
        parts.append(quote(start) + r"(?s:.*?)(?:" + quote(end) + r"[^\n]*+|\z)")
    return "|".join(parts)


def _pieces(token: Column, line: str | None, start: str | None, end: str | None) -> Column:
    """Comment text of one token, line by line."""
    matched, row = token["matched"], token["line"]
    body = F.lit(None).cast(COMMENT_TYPE)
    if start and end:
        inner = F.call_function(
            "substring_index", matched.substr(F.lit(len(start) + 1), F.length(matched)), F.lit(end), F.lit(1)
        )
        block = F.transform(
            F.split(inner, "\n", -1),
            lambda t, j: F.struct(F.lit("block").alias("kind"), (row + j).alias("line"), t.alias("body")),
        )
        body = F.when(F.startswith(matched, F.lit(start)), block)
    if line:
        single = F.array(
            F.struct(
                F.lit("line").alias("kind"),
                row.alias("line"),
                matched.substr(F.lit(len(line) + 1), F.length(matched)).alias("body"),
            )
        )
        body = F.coalesce(F.when(F.startswith(matched, F.lit(line)), single), body)
    return F.coalesce(body, F.array().cast(COMMENT_TYPE))


def comments(code: Column, language: Column) -> Column:
    """Comment pieces of a source text: kind, line and body without markers.

    One pattern per distinct syntax, chosen by language, so every pattern stays a literal.
    """
    by_syntax: dict[tuple, list[str]] = {}
    for name, syntax in SYNTAX.items():
        by_syntax.setdefault(syntax, []).append(name)

    def extract(syntax: tuple) -> Column:
        tokens = find_all(code, token_pattern(*syntax))
        return F.flatten(F.transform(tokens, lambda t: _pieces(t, *syntax)))

    chosen = None
    for syntax, names in by_syntax.items():
        if syntax == DEFAULT_SYNTAX:
            continue
        test = language.isin(*names)
        chosen = F.when(test, extract(syntax)) if chosen is None else chosen.when(test, extract(syntax))
    return chosen.otherwise(extract(DEFAULT_SYNTAX))


def with_comments(sources: DataFrame, code: str = "code", filename: str | None = None) -> DataFrame:
    named = F.col(filename) if filename else None
    return sources.withColumn("language", resolve_language(F.col(code), named)).withColumn(
        "comments", comments(F.col(code), F.col("language"))
    )


def comment_table(sources: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per comment line."""
    return rows_of(sources.select(key, "language", "comments"), (key, "language"), "comments", "ordinal")


def partition_features(sources: DataFrame, code: str = "code") -> DataFrame:
    """Characters inside comments and outside them, per source text."""
    inside = array_total(F.transform("comments", lambda c: F.length(c["body"]).cast("bigint")))
    return (
        sources.withColumn("n_comment_lines", F.size("comments"))
        .withColumn("comment_chars", inside)
        .withColumn("code_chars", F.length(code) - F.col("comment_chars"))
    )


def language_audit(sources: DataFrame, code: str = "code") -> DataFrame:
    """Comment share per language over the corpus."""
    return (
        partition_features(sources, code)
        .groupBy("language")
        .agg(
            F.count("*").alias("n_sources"),
            F.sum("n_comment_lines").alias("n_comment_lines"),
            F.sum("comment_chars").alias("comment_chars"),
            F.sum(F.length(code)).cast("bigint").alias("total_chars"),
        )
    )


def formal_opener(body: Column) -> Column:
    """Longest formal opener the comment starts with, or null."""
    core = F.lower(strip(body))
    ordered = sorted(FORMAL_OPENERS, key=len, reverse=True)
    return F.coalesce(*[F.when(F.startswith(core, F.lit(o)), F.lit(o)) for o in ordered])


def opener_audit(comment_rows: DataFrame) -> DataFrame:
    opened = comment_rows.withColumn("opener", formal_opener(F.col("body"))).filter(F.col("opener").isNotNull())
    return opened.groupBy("language", "opener").agg(F.count("*").alias("n_comments"))
