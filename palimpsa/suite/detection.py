"""Detection and cleaning queries with their plain-SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsa.functions import chars
from palimpsa.operators import clean, detect, heavy
from palimpsa.operators.detect import DetectionConfig
from palimpsa.plans import jobs
from palimpsa.suite import sqltext as q
from palimpsa.suite.corpus import documents, files, files_sql, marked, marked_sql

CONFIG = DetectionConfig(keywords=["wm-0", " M-00 ", "confidential"])
SENSITIVE = DetectionConfig(keywords=["CONFIDENTIAL", "confidential"], case_sensitive=True, detect_invisible=False)
REGEX = DetectionConfig(keywords=[r"WM-\d{4}", "(", "(a+)+$", "conf[a-z]+"], use_regex=True, detect_invisible=False)
KW = [(1, "wm-0", "(?i)wm-0"), (2, "M-00", "(?i)m-00"), (3, "confidential", "(?i)confidential")]

P = marked_sql()
NAMES = q.name_table()
INV = q.invisible()
KWS = q.keywords(KW)
SPANS = (
    "spans as (select doc_id, 'invisible' as kind, 'inv:' || position as id, position as s, position + 1 as e from inv "
    "union all select doc_id, 'keyword', 'kw:' || position || ':' || (position + length(m)), position, "
    "position + length(m) from kws)"
)
COUNTS = (
    "counts as (select doc_id, count(*) filter (kind = 'invisible') as removed_invisible, "
    "count(*) filter (kind = 'keyword') as removed_keyword from spans group by doc_id)"
)


DEEP = DetectionConfig(
    keywords=["(?:wm|-)+0", "(?:a|b)+", "(?:ab|ba)+", "m{,2}-"], use_regex=True, detect_invisible=False
)
MANY = DetectionConfig(keywords=[f"wm-0{i:02d}" for i in range(100)], detect_invisible=False)


def deep_patterns(spark, sf_dir):
    """Repeated groups over texts of which some are very long; none may end an executor."""
    long = marked(spark, sf_dir).withColumn(
        "text", F.when(F.col("doc_id") % 100 == 0, F.concat("text", F.repeat(F.lit("abba"), 50_000))).otherwise(F.col("text"))
    )
    found = detect.add_findings(long, DEEP)
    return found.select(
        "doc_id",
        *[
            F.size(F.filter("findings", lambda f: f["kw_ord"] == i)).alias(f"n{i}")  # noqa: B023
            for i in range(1, 5)
        ],
        F.coalesce(F.array_max(F.transform("findings", lambda f: F.length(f["matched_text"]))), F.lit(0)).alias("longest"),
    )


def many_keywords(spark, sf_dir):
    """A hundred keywords at once."""
    return detect.findings_table(marked(spark, sf_dir), MANY).select("doc_id", "keyword", "position")


HEAVY_SIZE, HEAVY_PARTS = 12, 4


def frequent_characters(spark, sf_dir):
    """Bounds of how often each source holds its most frequent characters, from summaries of four parts of the corpus."""
    letters = marked(spark, sf_dir).select(
        "source", (F.col("doc_id") % HEAVY_PARTS).alias("part"), F.explode(F.split("text", "")).alias("letter")
    )
    counts = letters.groupBy("part", "source", "letter").agg(F.count("*").alias("n"))
    summaries = heavy.summarize(counts, "part", "source", "letter", "n", HEAVY_SIZE)
    return heavy.merge(summaries, "part", "source", "letter", "n")


def rejected_patterns(spark, sf_dir):
    """What did not run stands beside what was found."""
    found = detect.add_findings(marked(spark, sf_dir), REGEX)
    rejected = F.transform(detect.rejected_keywords(spark, REGEX), lambda r: F.concat_ws(":", r["keyword"], r["reason"]))
    return found.select("doc_id", F.size("findings").alias("n"), F.array_join(rejected, ",").alias("rejected"))


def _rows(config):
    def run(spark, sf_dir):
        return detect.findings_table(marked(spark, sf_dir), config).select(
            "doc_id", "kind", "kw_ord", "id", "keyword", "matched_text", "position", "line", "column"
        )

    return run


def _keyword_sql(pairs):
    return (
        f"with {P}, {q.keywords(pairs)} select doc_id, 'keyword' as kind, cast(kw_ord as bigint) as kw_ord, "
        "'kw:' || position || ':' || (position + length(m)) as id, keyword, m as matched_text, position, "
        f"{q.lines()} from kws join planted using (doc_id)"
    )


def invisible_scan(spark, sf_dir):
    return detect.findings_table(marked(spark, sf_dir), DetectionConfig()).select(
        "doc_id", "id", "codepoint", "name", "position", "line", "column"
    )


def invisible_by_source(spark, sf_dir):
    """Flagged characters by source and class with subtotals; no offsets are needed for counts.

    Counted first and rolled up after, so the rows are not expanded once per subtotal level.
    """
    ch = marked(spark, sf_dir).select(
        "source", F.explode_outer(F.regexp_extract_all("text", F.lit(chars.FLAGGED_CLASS), F.lit(0))).alias("ch")
    )
    named = ch.filter(F.col("ch").isNotNull()).withColumn("class", chars.char_class(F.col("ch")))
    counted = named.groupBy("source", "class").agg(F.count("*").alias("n"))
    return counted.rollup("source", "class").agg(F.sum("n").alias("n"))


def invisible_names(spark, sf_dir):
    """Lookup of names by a join with the fixed table of single characters."""
    ch = marked(spark, sf_dir).select(
        F.explode_outer(F.regexp_extract_all("text", F.lit(chars.FLAGGED_CLASS), F.lit(0))).alias("ch")
    ).filter(F.col("ch").isNotNull())
    counted = ch.groupBy("ch").agg(F.count("*").alias("n")).withColumn("cp", F.ascii("ch"))
    return counted.join(F.broadcast(chars.char_table(spark)), "cp").select(
        chars.code_point_label(F.col("ch")).alias("codepoint"), "name", "n"
    )


def tag_ranges(spark, sf_dir):
    """Range lookup as an equality join on the 128-wide block, then the exact range test."""
    ch = marked(spark, sf_dir).select(
        "doc_id", F.explode_outer(F.regexp_extract_all("text", F.lit(chars.FLAGGED_CLASS), F.lit(0))).alias("ch")
    ).filter(F.col("ch").isNotNull())
    coded = ch.withColumn("cp", F.ascii("ch")).withColumn("block", F.shiftright("cp", 7))
    hit = coded.join(F.broadcast(chars.range_table(spark)), "block").filter("cp between lo and hi")
    return hit.groupBy("doc_id", "name").agg(F.count("*").alias("n"))


def findings_per_document(spark, sf_dir):
    found = detect.add_findings(marked(spark, sf_dir), CONFIG)
    return found.select(
        "doc_id",
        detect.count_kind(F.col("findings"), "invisible").alias("n_invisible"),
        detect.count_kind(F.col("findings"), "keyword").alias("n_keyword"),
        F.size("findings").alias("total_findings"),
        (F.size("findings") == 0).alias("clean"),
    )


def unsafe_patterns(spark, sf_dir):
    shaped = marked(spark, sf_dir).selectExpr(
        "doc_id",
        """case doc_id % 6 when 0 then '(' || source || '+)+$' when 1 then text when 2 then repeat('(a)', cast(doc_id % 40 as int))
           when 3 then '.*' || source || '.*.*' when 4 then '(x*){2,}' else source || '[a-z]+' end as pattern""",
    )
    return shaped.select("doc_id", detect.is_risky_pattern(F.col("pattern")).alias("unsafe"))


def strip_invisible(spark, sf_dir):
    return marked(spark, sf_dir).select("doc_id", clean.strip_invisible(F.col("text")).alias("cleaned"))


def clean_documents(spark, sf_dir):
    return clean.clean(marked(spark, sf_dir), CONFIG).select(
        "doc_id", "cleaned", "preview", "removed_invisible", "removed_keyword"
    )


def selected_removal(spark, sf_dir):
    chosen = marked(spark, sf_dir).selectExpr(
        "*",
        "case when doc_id % 2 = 0 then null when doc_id % 3 = 0 then array() "
        "else array('inv:' || length(text), 'inv:' || (length(text) - 1), 'inv:' || (length(text) - 2)) end as inv",
        "case when doc_id % 5 = 0 then array('kw:' || (length(text) - 12) || ':' || length(text)) end as kw",
    )
    return clean.clean(chosen, CONFIG, "inv", "kw", with_preview=False).select(
        "doc_id", "cleaned", "removed_invisible", "removed_keyword"
    )


def chosen_findings(spark, sf_dir):
    """Persisted findings kept by a semi join with a selection table."""
    docs = marked(spark, sf_dir)
    found = detect.findings_table(docs, CONFIG).select("doc_id", "kind", "id")
    selection = docs.selectExpr("doc_id", "'invisible' as kind", "'inv:' || (length(text) - 1) as id")
    return found.join(selection, ["doc_id", "kind", "id"], "left_semi")


def untouched_documents(spark, sf_dir):
    return detect.add_findings(marked(spark, sf_dir), CONFIG).filter(F.size("findings") == 0).select("doc_id", "source")


def _span_table(spark, sf_dir):
    return detect.findings_table(marked(spark, sf_dir), CONFIG).select(
        "doc_id", F.col("position").alias("start"), (F.col("position") + F.length("matched_text")).alias("end")
    )


def span_union(spark, sf_dir):
    return clean.merge_span_table(_span_table(spark, sf_dir)).select(
        "doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end")
    )


def kept_segments(spark, sf_dir):
    islands = clean.merge_span_table(_span_table(spark, sf_dir))
    return clean.kept_segments(islands, marked(spark, sf_dir)).select("doc_id", "seg", "seg_start", "seg_end")


def clean_from_span_table(spark, sf_dir):
    islands = clean.merge_span_table(_span_table(spark, sf_dir))
    return clean.apply_span_table(marked(spark, sf_dir), islands).select("doc_id", "cleaned")


def removed_by_source(spark, sf_dir):
    spanned = clean.removal_spans(marked(spark, sf_dir), CONFIG)
    return spanned.groupBy("source").agg(
        F.sum("removed_invisible").alias("removed_invisible"), F.sum("removed_keyword").alias("removed_keyword")
    )


def digit_offsets(spark, sf_dir):
    config = DetectionConfig(keywords=["[0-9]{3,}"], use_regex=True, detect_invisible=False)
    return detect.findings_table(documents(spark, sf_dir), config).select(
        "doc_id", "matched_text", "position", "line", "column"
    )


def most_flagged_documents(spark, sf_dir):
    return (
        findings_per_document(spark, sf_dir)
        .select("doc_id", "total_findings")
        .orderBy(F.desc("total_findings"), "doc_id")
        .limit(25)
    )


def clean_corpus(spark, sf_dir):
    named = marked(spark, sf_dir).na.fill({"filename": "pasted_text.txt"})
    return jobs.clean_corpus(named, CONFIG, with_preview=False).select("doc_id", "out_name", "out_path", "cleaned")


def clean_batches(spark, sf_dir):
    return jobs.clean_batches(files(spark, sf_dir).na.fill({"filename": "x"}), CONFIG, 17).select(
        "batch", "doc_id", "status", "message", "out_name", "cleaned", "removed_invisible", "removed_keyword"
    )


CLEANED = "string_agg(kept, '' order by k) as cleaned"
BODY = f"{P}, {INV}, {KWS}, {SPANS}"
ISL = q.islands("spans")
SEG = q.segments()
PER_DOC = (
    "select doc_id, coalesce(removed_invisible, 0) as n_invisible, coalesce(removed_keyword, 0) as n_keyword, "
    "coalesce(removed_invisible, 0) + coalesce(removed_keyword, 0) as total_findings, counts.doc_id is null as clean "
    "from planted left join counts using (doc_id)"
)

QUERIES = {
    "invisible_scan": (
        invisible_scan,
        f"with {P}, {NAMES}, {INV} select doc_id, 'inv:' || position as id, {q.label('ord(m)')} as codepoint, name, "
        f"position, {q.lines()} from inv join planted using (doc_id) join names on cp = ord(m)",
    ),
    "invisible_by_source": (
        invisible_by_source,
        f"with {P}, {NAMES}, x as (select source, unnest(regexp_extract_all(text, '{q.FLAGGED}')) as m from planted) "
        "select source, class, count(*) as n from x join names on cp = ord(m) group by rollup (source, class)",
    ),
    "invisible_names": (
        invisible_names,
        f"with {P}, {NAMES}, {INV} select {q.label('ord(m)')} as codepoint, name, count(*) as n from inv "
        "join names on cp = ord(m) where class <> 'tag' group by all",
    ),
    "tag_ranges": (
        tag_ranges,
        f"with {P}, {NAMES}, {INV} select doc_id, name, count(*) as n from inv join names on cp = ord(m) "
        "where class = 'tag' group by all",
    ),
    "keywords_any_case": (
        _rows(DetectionConfig(keywords=["wm-0", " M-00 ", "confidential"], detect_invisible=False)), _keyword_sql(KW)
    ),
    "keywords_exact_case": (
        _rows(SENSITIVE), _keyword_sql([(1, "CONFIDENTIAL", "CONFIDENTIAL"), (2, "confidential", "confidential")])
    ),
    "deep_patterns": (
        deep_patterns,
        f"with {P}, t as (select doc_id, case when doc_id % 100 = 0 then text || repeat('abba', 50000) else text end as text from planted), "
        "f as (select doc_id, regexp_extract_all(text, '(?i)(?:wm|-)+0') as a, regexp_extract_all(text, '(?i)[ab]+') as b, "
        "regexp_extract_all(text, '(?i)(?:ab|ba)+') as c, regexp_extract_all(text, '(?i)m{0,2}-') as d from t) "
        "select doc_id, len(a) as n1, len(b) as n2, len(c) as n3, len(d) as n4, coalesce(list_max(list_transform("
        "list_concat(a, b, c, d), lambda x: length(x))), 0) as longest from f",
    ),
    "many_keywords": (
        many_keywords,
        f"with {P} select doc_id, lower(m) as keyword, position from ({q.sites('planted', 'text', '(?i)wm-0[0-9]{2}')})",
    ),
    "frequent_characters": (
        frequent_characters,
        f"with {P}, counts as (select source, doc_id % {HEAVY_PARTS} as part, letter, count(*) as n "
        "from (select source, doc_id, unnest(string_split(text, '')) as letter from planted) group by all), "
        "ranked as (select *, row_number() over (partition by part, source order by n desc, letter) as rank from counts), "
        f"bounds as (select part, source, coalesce(max(n) filter (rank = {HEAVY_SIZE + 1}), 0) as left_out from ranked group by all), "
        "whole as (select source, sum(left_out) as missed from bounds group by source), "
        f"kept as (select source, letter, sum(n) as lower, sum(left_out) as own from ranked join bounds using (part, source) "
        f"where rank <= {HEAVY_SIZE} group by all) select source, letter, cast(lower as bigint) as lower, "
        "cast(lower + missed - own as bigint) as upper, cast(missed as bigint) as missed from kept join whole using (source)",
    ),
    "rejected_patterns": (
        rejected_patterns,
        f"with {P} select doc_id, len(regexp_extract_all(text, '(?i)WM-[0-9]{{4}}')) + len(regexp_extract_all(text, '(?i)conf[a-z]+')) "
        "as n, '(:invalid,(a+)+$:unsafe' as rejected from planted",
    ),
    "keywords_regex_vetted": (
        _rows(REGEX), _keyword_sql([(1, r"WM-\d{4}", "(?i)WM-[0-9]{4}"), (2, "conf[a-z]+", "(?i)conf[a-z]+")])
    ),
    "combined_findings": (
        _rows(CONFIG),
        f"with {P}, {INV}, {KWS}, u as (select doc_id, 'invisible' as kind, 0 as kw_ord, 'inv:' || position as id, "
        "cast(null as varchar) as keyword, m, position from inv union all select doc_id, 'keyword', kw_ord, "
        "'kw:' || position || ':' || (position + length(m)), keyword, m, position from kws) "
        "select doc_id, kind, cast(kw_ord as bigint) as kw_ord, id, keyword, m as matched_text, position, "
        f"{q.lines()} from u join planted using (doc_id)",
    ),
    "findings_per_document": (findings_per_document, f"with {BODY}, {COUNTS} {PER_DOC}"),
    "unsafe_patterns": (
        unsafe_patterns,
        f"with {P}, pats as (select doc_id, case doc_id % 6 when 0 then '(' || source || '+)+$' when 1 then text "
        "when 2 then repeat('(a)', doc_id % 40) when 3 then '.*' || source || '.*.*' when 4 then '(x*){2,}' "
        "else source || '[a-z]+' end as pattern from planted) select doc_id, length(pattern) > 200 "
        "or len(string_split(pattern, '(')) - 1 > 20 "
        r"or regexp_matches(pattern, '\([^()]*[+*]\)[+*]|\([^()]*[+*]\)\{[0-9]*,|([.][+*]){3,}') as unsafe from pats",
    ),
    "strip_invisible": (
        strip_invisible,
        f"with {P} select doc_id, regexp_replace(text, '{q.FLAGGED}', '', 'g') as cleaned from planted",
    ),
    "clean_documents": (
        clean_documents,
        f"with {BODY}, {ISL}, {SEG}, {COUNTS}, built as (select doc_id, {CLEANED}, string_agg({q.escape('kept')} || "
        "case when gone = '' then '' else '<del class=\"wm-removed\">' || "
        f"{q.escape('gone')} || '</del>' end, '' order by k) as preview from seg group by doc_id) "
        "select doc_id, cleaned, preview, coalesce(removed_invisible, 0) as removed_invisible, "
        "coalesce(removed_keyword, 0) as removed_keyword from built left join counts using (doc_id)",
    ),
    "selected_removal": (
        selected_removal,
        f"with {P}, {INV}, {KWS}, all_{SPANS}, sel as (select doc_id, length(text) as n from planted), "
        "spans as (select a.* from all_spans a join sel using (doc_id) where case when kind = 'keyword' "
        "then doc_id % 5 <> 0 or id = 'kw:' || (n - 12) || ':' || n else doc_id % 2 = 0 or (doc_id % 3 <> 0 and id in "
        f"('inv:' || n, 'inv:' || (n - 1), 'inv:' || (n - 2))) end), {ISL}, {SEG}, {COUNTS}, "
        f"built as (select doc_id, {CLEANED} from seg group by doc_id) select doc_id, cleaned, "
        "coalesce(removed_invisible, 0) as removed_invisible, coalesce(removed_keyword, 0) as removed_keyword "
        "from built left join counts using (doc_id)",
    ),
    "chosen_findings": (
        chosen_findings,
        f"with {BODY} select doc_id, kind, id from spans join planted using (doc_id) "
        "where kind = 'invisible' and id = 'inv:' || (length(text) - 1)",
    ),
    "untouched_documents": (
        untouched_documents,
        f"with {BODY} select doc_id, source from planted where doc_id not in (select doc_id from spans)",
    ),
    "span_union": (span_union, f"with {BODY}, {ISL} select doc_id, s as span_start, e as span_end from isl"),
    "kept_segments": (
        kept_segments,
        f"with {BODY}, {ISL}, {SEG} select doc_id, k - 1 as seg, p as seg_start, s as seg_end from seg",
    ),
    "clean_from_span_table": (
        clean_from_span_table, f"with {BODY}, {ISL}, {SEG} select doc_id, {CLEANED} from seg group by doc_id"
    ),
    "removed_by_source": (
        removed_by_source,
        f"with {BODY}, {COUNTS} select source, cast(sum(coalesce(removed_invisible, 0)) as bigint) as removed_invisible, "
        "cast(sum(coalesce(removed_keyword, 0)) as bigint) as removed_keyword from planted left join counts "
        "using (doc_id) group by source",
    ),
    "digit_offsets": (
        digit_offsets,
        f"with x as ({q.sites('documents', 'text', '[0-9]{3,}')}) select doc_id, m as matched_text, position, "
        f"{q.lines()} from x join documents using (doc_id)",
    ),
    "most_flagged_documents": (
        most_flagged_documents,
        f"with {BODY}, {COUNTS} select doc_id, total_findings from ({PER_DOC}) order by total_findings desc, doc_id limit 25",
    ),
    "clean_corpus": (
        clean_corpus,
        f"with {BODY}, {ISL}, {SEG}, built as (select doc_id, {CLEANED} from seg group by doc_id) select doc_id, "
        "'clean_' || coalesce(filename, 'pasted_text.txt') as out_name, doc_id || '/clean_' || "
        "coalesce(filename, 'pasted_text.txt') as out_path, cleaned from built join planted using (doc_id)",
    ),
    "clean_batches": (
        clean_batches,
        f"with {BODY}, {COUNTS}, {files_sql()}, {ISL}, {SEG}, built as (select doc_id, {CLEANED} from seg group by doc_id), "
        "sized as (select *, count(*) over (partition by batch) <= 17 as fits from files) "
        "select batch, doc_id, case when fits then 'ok' else 'error' end as status, case when not fits then 'too_many_files' "
        "end as message, case when fits then 'clean_' || coalesce(filename, 'x') end as out_name, "
        "case when fits then cleaned end as cleaned, case when fits then coalesce(removed_invisible, 0) end as removed_invisible, "
        "case when fits then coalesce(removed_keyword, 0) end as removed_keyword "
        "from built join sized using (doc_id) left join counts using (doc_id)",
    ),
}
