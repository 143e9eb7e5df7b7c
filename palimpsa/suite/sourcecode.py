"""Source-code queries with their plain-SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsa.operators import code
from palimpsa.plans import jobs
from palimpsa.suite import sqltext as q
from palimpsa.suite.corpus import sources, sources_sql, table

S = sources_sql()


def code_language(spark, sf_dir):
    named = sources(spark, sf_dir).withColumn(
        "explicit", F.when(F.col("doc_id") % 7 == 0, "Go").when(F.col("doc_id") % 7 == 1, "auto")
    )
    return named.select(
        "doc_id", code.resolve_language(F.col("code"), F.col("filename"), F.col("explicit")).alias("language")
    )


def code_comments(spark, sf_dir):
    extracted = code.with_comments(sources(spark, sf_dir), "code", "filename")
    return code.comment_table(extracted).select("doc_id", "language", "kind", "line", "body")


def code_partition(spark, sf_dir):
    return jobs.audit_code(sources(spark, sf_dir)).select(
        "doc_id", "language", "n_comment_lines", "comment_chars", "code_chars"
    )


def language_audit(spark, sf_dir):
    return code.language_audit(code.with_comments(sources(spark, sf_dir), "code", "filename"))


def formal_openers(spark, sf_dir):
    return code.opener_audit(code.comment_table(code.with_comments(sources(spark, sf_dir), "code", "filename")))


def page_comments(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("code"))
    found = code.partition_features(pages.withColumn("language", F.lit("html")).withColumn(
        "comments", code.comments(F.col("code"), F.lit("html"))
    ))
    return found.select("doc_id", "n_comment_lines", "comment_chars", "code_chars")


def _token(line: str | None, start: str | None, end: str | None) -> str:
    """The token pattern without possessive repeats, which this regex dialect lacks and does not need."""
    esc = lambda m: "".join("\\" + c if c in "*/<>!-#" else c for c in m)
    parts = [rf"{x}[^{x}\\\n]*(?:\\[^\n]?[^{x}\\\n]*)*{x}?" for x in ("''", '"', "`")]
    if line:
        parts.append(esc(line) + r"[^\n]*")
    if start:
        parts.append(esc(start) + r"(?s:.*?)(?:" + esc(end) + r"[^\n]*|\z)")
    return "|".join(parts)


def _tokens(source: str) -> str:
    groups: dict[tuple, list[str]] = {}
    for name, syntax in code.SYNTAX.items():
        groups.setdefault(syntax, []).append(name)
    parts = []
    for (line, start, end), names in groups.items():
        inside = ", ".join(f"'{n}'" for n in names)
        sites = q.sites(f"(select doc_id, code from {source} where language in ({inside}))", "code", _token(line, start, end))
        parts.append(
            f"select doc_id, i, m, position, {len(line or '')} as ll, {len(start or '')} as sl, "
            f"{'starts_with(m, ' + chr(39) + line + chr(39) + ')' if line else 'false'} as is_line, "
            f"{'starts_with(m, ' + chr(39) + start + chr(39) + ')' if start else 'false'} as is_block, "
            f"{chr(39) + end + chr(39) if end else 'null'} as closing from ({sites})"
        )
    return (
        f"tok as ({' union all '.join(parts)}), "
        "body as (select doc_id, i, case when is_line then 'line' else 'block' end as kind, "
        "length(before) - length(replace(before, chr(10), '')) as first_line, case when is_line then [substr(m, ll + 1)] "
        "else string_split(split_part(substr(m, sl + 1), closing, 1), chr(10)) end as bs from "
        "(select t.*, substr(code, 1, cast(position as int)) as before from tok t join " + source + " using (doc_id)) "
        "where is_line or is_block), "
        "com as (select doc_id, kind, first_line + generate_subscripts(bs, 1) as line, unnest(bs) as body from body)"
    )


def _sniff(x: str) -> str:
    h = x
    return (
        rf"case when regexp_matches({h}, '^\s*#!.*python') or regexp_matches({h}, '\bdef \w+\(.*\):') or "
        rf"regexp_matches({h}, '(?m)^\s*(import|from)\s+\w+') then 'python' when contains({h}, '<?php') then 'php' "
        rf"when regexp_matches({h}, '(?i)<!DOCTYPE html>|<html[\s>]') then 'html' when contains({h}, 'public class') or "
        rf"regexp_matches({h}, '(?m)^\s*package\s+[\w.]+;') then 'java' when regexp_matches({h}, '\bfn \w+\(') and contains({h}, '->') then 'rust' "
        rf"when regexp_matches({h}, '(?m)^\s*package\s+\w+') and regexp_matches({h}, '\bfunc \w+\(') then 'go' "
        rf"when regexp_matches({h}, '(?i)\b(SELECT|INSERT INTO|UPDATE|DELETE FROM)\b') then 'sql' else 'javascript' end"
    )


def _language(explicit: str) -> str:
    suffixes = " ".join(f"when '{e}' then '{n}'" for e, n in code.EXTENSIONS.items())
    known = ", ".join(f"'{n}'" for n in code.SYNTAX)
    return (
        f"coalesce(case when lower({explicit}) in ({known}) then lower({explicit}) end, case when contains(filename, '.') then "
        f"case lower(split_part(filename, '.', -1)) {suffixes} end end, {_sniff('code')})"
    )


LANG = f"{S}, src as (select *, {_language('cast(null as varchar)')} as language from sources)"
COM = f"{LANG}, {_tokens('src')}"
PER = (
    "per as (select s.doc_id, language, count(c.doc_id) as n_comment_lines, coalesce(cast(sum(length(body)) as bigint), 0) as comment_chars, "
    "any_value(length(code)) as total from src s left join com c on c.doc_id = s.doc_id group by 1, 2)"
)
OPENERS = " ".join(
    f"when starts_with(lower({q.strip('body')}), '{o}') then '{o}'" for o in sorted(code.FORMAL_OPENERS, key=len, reverse=True)
)
PAGES = "src as (select page_id as doc_id, html as code, 'html' as language from pages)"

QUERIES = {
    "code_language": (
        code_language,
        f"with {S}, e as (select *, case doc_id % 7 when 0 then 'Go' when 1 then 'auto' end as explicit from sources) "
        f"select doc_id, {_language('explicit')} as language from e",
    ),
    "code_comments": (
        code_comments, f"with {COM} select doc_id, language, kind, line, body from com join src using (doc_id)"
    ),
    "code_partition": (
        code_partition,
        f"with {COM}, {PER} select doc_id, language, n_comment_lines, comment_chars, total - comment_chars as code_chars from per",
    ),
    "language_audit": (
        language_audit,
        f"with {COM}, {PER} select language, count(*) as n_sources, cast(sum(n_comment_lines) as bigint) as n_comment_lines, "
        "cast(sum(comment_chars) as bigint) as comment_chars, cast(sum(total) as bigint) as total_chars from per group by language",
    ),
    "formal_openers": (
        formal_openers,
        f"with {COM}, o as (select language, case {OPENERS} end as opener from com join src using (doc_id)) "
        "select language, opener, count(*) as n_comments from o where opener is not null group by all",
    ),
    "page_comments": (
        page_comments,
        f"with {PAGES}, {_tokens('src')}, {PER} select doc_id, n_comment_lines, comment_chars, total - comment_chars as code_chars from per",
    ),
}
