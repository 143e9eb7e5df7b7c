"""Style, validation and source queries with their plain-SQL counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from palimpsa.functions import texts
from palimpsa.operators import clean, style, validate
from palimpsa.operators.detect import rows_of
from palimpsa.plans import jobs
from palimpsa.session import checkpoint_dir
from palimpsa.sources import documents as docs
from palimpsa.sources import files as raw
from palimpsa.sources import sinks
from palimpsa.suite import sqltext as q
from palimpsa.suite.corpus import documents, files, files_sql, marked, marked_sql, prose, prose_sql, table
from palimpsa.suite.detection import BODY, CONFIG, COUNTS

P = marked_sql()
CUSTOM = ["confidential", "the ", "cabe"]


def sentence_split(spark, sf_dir):
    split = documents(spark, sf_dir).select(
        "doc_id", F.transform(texts.sentences(F.col("text")), lambda s: F.struct(s.alias("sentence"))).alias("_s")
    )
    return rows_of(split, ("doc_id",), "_s", "n")


def word_tokens(spark, sf_dir):
    """Corpus vocabulary: occurrences per word."""
    words = marked(spark, sf_dir).select(F.explode_outer(texts.words(F.col("text"))).alias("w"))
    return words.filter(F.col("w").isNotNull()).groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n"))


def style_features(spark, sf_dir):
    return style.add_features(marked(spark, sf_dir)).select(
        "doc_id", "n_sentences", "n_words", "n_distinct_words", "sum_len", "sum_len_sq", "n_period", "sum_commas",
        "sum_commas_sq",
    )


def style_score(spark, sf_dir):
    return style.add_score(marked(spark, sf_dir)).select(
        "doc_id", "length_points", "diversity_points", "phrase_points", "punctuation_points", "max_points", "score",
        F.array_join("signals", ",").alias("signals"), F.array_join("phrases", ",").alias("phrases"),
        style.band(F.col("score")).alias("band"),
    )


def phrase_presence(spark, sf_dir):
    found = prose(spark, sf_dir).select(
        F.explode_outer(style.present_phrases(F.lower("text"))).alias("phrase")
    )
    return found.filter(F.col("phrase").isNotNull()).groupBy("phrase").agg(F.count("*").alias("n_docs"))


def custom_phrases(spark, sf_dir):
    scored = style.add_score(marked(spark, sf_dir), phrases=CUSTOM)
    return scored.select("doc_id", "phrase_points", F.array_join("phrases", "|").alias("phrases"))


def sentence_statistics(spark, sf_dir):
    described = style.ratios(style.add_features(documents(spark, sf_dir)))
    return described.select(
        "doc_id", F.round("mean_len", 6).alias("mean_len"), F.round("stdev_len", 6).alias("stdev_len"),
        F.round("type_token", 6).alias("type_token"),
    )


def score_before_after(spark, sf_dir):
    stripped = marked(spark, sf_dir).withColumn("stripped", clean.strip_invisible(F.col("text")))
    return style.compare(stripped, "text", "stripped").select(
        "doc_id", "score_before", "score_after", "delta", "direction"
    )


CHANGED = "replace(replace(text, ', ', '. '), 'destacar', 'decir')"


def band_transitions(spark, sf_dir):
    """Bands of whole texts before and after a change of all their commas and one phrase."""
    changed = prose(spark, sf_dir).withColumn("changed", F.expr(CHANGED))
    return style.band_transitions(style.compare(changed, "text", "changed"))


def _broken():
    return validate.violations(F.col("text"), F.col("filename"), max_chars=3000, max_bytes=4000)


def _limits_frame(spark, sf_dir):
    return marked(spark, sf_dir).selectExpr(
        "doc_id", "case when doc_id % 13 = 0 then repeat(filename, 40) else filename end as filename",
        "case when doc_id % 17 = 0 then ' \\n\\u2003 ' when doc_id % 19 = 0 then null else text end as text",
    )


def validation(spark, sf_dir):
    return validate.with_status(_limits_frame(spark, sf_dir), _broken()).select("doc_id", "status", "message")


def quarantine(spark, sf_dir):
    refused = validate.split_quarantine(validate.with_status(_limits_frame(spark, sf_dir), _broken()))[1]
    return refused.groupBy("message").agg(F.count("*").alias("n"))


def batch_file_cap(spark, sf_dir):
    return validate.flag_oversized_batches(files(spark, sf_dir).select("batch", "doc_id"), cap=17)


def batch_budget(spark, sf_dir):
    """Some files have no batch and one has no order; none may be lost."""
    meta = files(spark, sf_dir).selectExpr(
        "doc_id", "case when doc_id % 10 = 7 then null else batch end as batch",
        "case when doc_id = 3 then null else ord end as ord", "bytes",
    )
    return validate.apply_byte_budget(meta, cap=40_000)


def batch_scan(spark, sf_dir):
    scanned = jobs.scan_batches(files(spark, sf_dir).na.fill({"filename": "x"}), CONFIG, 17, 30_000)
    return scanned.select(
        "batch", "doc_id", "status", "message", "original_length", "n_invisible", "n_keyword", "total_findings", "clean",
        "score", "band", F.array_join("signals", ",").alias("signals"), F.size("findings").alias("n_rows"),
    )


def scan_corpus(spark, sf_dir):
    """The whole job: findings with their places, counts, clean flag, score, band and signals."""
    scanned = jobs.scan_corpus(marked(spark, sf_dir).drop("filename"), CONFIG)
    return scanned.select(
        "doc_id", "filename", "file_type", "original_length", "n_invisible", "n_keyword", "total_findings", "clean",
        "score", "band", F.array_join("signals", ",").alias("signals"),
        _places(F.col("findings"), "invisible").alias("invisible_places"),
        _places(F.col("findings"), "keyword").alias("keyword_places"),
    )


def _places(found, kind):
    """Findings of a kind in their order, written out."""
    rows = F.filter(found, lambda f: f["kind"] == kind)
    return F.array_join(F.transform(rows, lambda f: F.concat_ws(":", f["id"], f["codepoint"], f["keyword"])), ",")


def nested_results(spark, sf_dir):
    nested = sinks.nested_result(jobs.scan_corpus(marked(spark, sf_dir).na.fill({"filename": "x"}), CONFIG))
    return nested.select(
        "doc_id", "result.filename", "result.original_length", "result.total_findings", "result.clean",
        "result.style.score", F.array_join("result.style.signals", ",").alias("signals"),
        _places(F.col("result.invisible_chars"), "invisible").alias("invisible_places"),
        _places(F.col("result.keyword_matches"), "keyword").alias("keyword_places"),
    )


def batch_summary(spark, sf_dir):
    scanned = jobs.scan_batches(files(spark, sf_dir).na.fill({"filename": "x"}), CONFIG, 17, 30_000)
    return validate.batch_summary(scanned)


def file_routing(spark, sf_dir):
    names = marked(spark, sf_dir).select(F.coalesce("filename", F.lit("")).alias("filename"))
    urls = table(spark, sf_dir, "pages").select(F.col("url").alias("filename"))
    named = names.unionByName(urls)
    return named.groupBy(
        texts.file_extension(F.col("filename")).alias("ext"), docs.file_label(F.col("filename")).alias("label"),
        docs.file_route(F.col("filename")).alias("route"),
    ).agg(F.count("*").alias("n"))


def bytes_fallback(spark, sf_dir):
    data = documents(spark, sf_dir).select(
        "doc_id",
        F.when(
            (F.col("doc_id") % 3 == 0) & (F.col("lang") == "es"),
            F.encode(F.regexp_replace("text", r"[^\x{0}-\x{FF}]", "?"), "ISO-8859-1"),
        )
        .when(F.col("doc_id") % 5 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")))
        .otherwise(F.encode("text", "UTF-8"))
        .alias("content"),
    )
    return data.select("doc_id", raw.bytes_to_text(F.col("content")).alias("text"))


def fragment_assembly(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("turn") % 5 != 3, F.col("text")))
    return docs.assemble(turns, "conv_id", ["turn"])


def keyword_fields(spark, sf_dir):
    fields = documents(spark, sf_dir).select("doc_id", F.translate("text", " ", ",").alias("field"))
    return docs.keyword_rows(fields, "doc_id", "field")


def ranked_keywords(spark, sf_dir):
    """The same over a keyword table: ranks of a hot key come from stretches of it."""
    listed = table(spark, sf_dir, "events").select("event_type", "event_id", F.col("props").alias("keyword"))
    return docs.ranked_keywords(listed, "event_type", "event_id").select("event_type", "kw_ord", "keyword", "within_limit")


def default_filenames(spark, sf_dir):
    named = docs.with_filename(marked(spark, sf_dir), F.col("filename"))
    return named.groupBy("filename").agg(F.count("*").alias("n"))


PACK = 100_000


def _text_files(spark, sf_dir):
    """The planted corpus as text files in the shared folder, by source, in packs of about 100 kB."""
    path = f"{checkpoint_dir(spark)}/palimpsa-{uuid.uuid4().hex}"
    sinks.write_packs(marked(spark, sf_dir).select("source", "doc_id", "text"), path, "source", "doc_id", pack_bytes=PACK)
    return path


def scanned_files(spark, sf_dir):
    """Metadata of the files only: number, bytes and label by folder."""
    listed = raw.list_files(spark, _text_files(spark, sf_dir)).filter(F.col("filename").startswith("part-"))
    folder = F.regexp_extract("path", r"/source=([^/]*)/", 1)
    return listed.groupBy(folder.alias("source"), docs.file_label(F.col("filename")).alias("file_type")).agg(
        F.count("*").alias("n_files"), F.sum("bytes").alias("bytes")
    )


def file_findings(spark, sf_dir):
    """Whole files scanned by the file job, summed by folder."""
    scanned = jobs.scan_files(spark, _text_files(spark, sf_dir), CONFIG).filter(F.col("filename").startswith("part-"))
    folder = F.regexp_extract("path", r"/source=([^/]*)/", 1)
    return scanned.groupBy(folder.alias("source"), "status", "file_type").agg(
        F.sum("n_invisible").alias("n_invisible"), F.sum("n_keyword").alias("n_keyword"),
        F.sum("original_length").alias("original_length"), F.count_if("clean").alias("n_clean"),
    )


SENT = f"sent as (select doc_id, {q.sentences('text')} as ss, text from planted)"
FEATURES = f"""{SENT}, feat as (select doc_id, text, cast(len(ss) as bigint) as n_sentences,
  cast(len(regexp_extract_all(text, '{q.WORD}')) as bigint) as n_words,
  cast(len(list_distinct(list_transform(regexp_extract_all(text, '{q.WORD}'), lambda w: lower(w)))) as bigint) as n_distinct_words,
  coalesce(cast(list_sum(list_transform(ss, lambda s: {q.word_count('s')})) as bigint), 0) as sum_len,
  coalesce(cast(list_sum(list_transform(ss, lambda s: {q.word_count('s')} * {q.word_count('s')})) as bigint), 0) as sum_len_sq,
  cast(len(list_filter(ss, lambda s: s[-1] = '.')) as bigint) as n_period,
  coalesce(cast(list_sum(list_transform(ss, lambda s: length(s) - length(replace(s, ',', '')))) as bigint), 0) as sum_commas,
  coalesce(cast(list_sum(list_transform(ss, lambda s: (length(s) - length(replace(s, ',', ''))) ** 2)) as bigint), 0) as sum_commas_sq
  from sent)"""


def _score_sql(phrases: list[str], name: str = "scored") -> str:
    listed = ", ".join(f"'{p}'" for p in phrases)
    return f"""pts as (select *, list_filter([{listed}], lambda p: contains(lower(text), p)) as ph,
      case when n_sentences < 3 then 0 when sum_len = 0
        or sqrt((n_sentences * sum_len_sq - sum_len * sum_len)::double) / sum_len < 0.35 then 25
        when sqrt((n_sentences * sum_len_sq - sum_len * sum_len)::double) / sum_len < 0.55 then 12 else 0 end as length_points,
      case when n_words < 20 then 0 when n_distinct_words / n_words < 0.4 then 25
        when n_distinct_words / n_words < 0.55 then 12 else 0 end as diversity_points,
      case when n_sentences < 3 then 0 when n_period / n_sentences > 0.9
        and (n_sentences * sum_commas_sq - sum_commas * sum_commas) < n_sentences * n_sentences then 20
        when n_period / n_sentences > 0.75 then 10 else 0 end as punctuation_points,
      30 + case when n_sentences >= 3 then 45 else 0 end + case when n_words >= 20 then 25 else 0 end as max_points from feat),
    {name} as (select *, least(30, 10 * len(ph)) as phrase_points,
      round((length_points + diversity_points + punctuation_points + least(30, 10 * len(ph))) * 100.0 / max_points, 1)::double as score
      from pts)"""


BAND = "case when {0} >= 65 then 'high' when {0} >= 35 then 'medium' else 'low' end"
SIGNALS = """coalesce(nullif(array_to_string(list_filter([case length_points when 25 then 'length_strong' when 12 then 'length_moderate' end,
  case diversity_points when 25 then 'diversity_strong' when 12 then 'diversity_moderate' end,
  case when phrase_points > 0 then 'phrases' end,
  case punctuation_points when 20 then 'punctuation_strong' when 10 then 'punctuation_moderate' end], lambda x: x is not null), ','), ''), 'none')"""


def _two_scores(source: str, first: str, second: str) -> str:
    """Both versions as one relation, scored together; id = doc_id * 2 (+ 1 for the second)."""
    both = (
        f"planted as (select doc_id * 2 as doc_id, {first} as text from {source} "
        f"union all select doc_id * 2 + 1, {second} from {source})"
    )
    return f"{both}, {FEATURES}, {_score_sql(style.CONNECTOR_PHRASES)}, " + (
        "pair as (select a.doc_id // 2 as doc_id, a.score as score_before, b.score as score_after "
        "from scored a join scored b on b.doc_id = a.doc_id + 1 where a.doc_id % 2 = 0)"
    )


BASE = P.replace("planted as", "base as", 1)
LIMITED = (
    "lim as (select doc_id, case when doc_id % 13 = 0 then repeat(filename, 40) else filename end as filename, "
    "case when doc_id % 17 = 0 then ' ' || chr(10) || chr(8195) || ' ' when doc_id % 19 = 0 then null else text end "
    f"as text from planted), broken as (select doc_id, nullif(concat_ws(',', case when length(text) > 3000 then 'too_long' end, "
    f"case when {q.strip('coalesce(text, chr(32))')} = '' then 'blank' end, case when strlen(text) > 4000 then 'too_many_bytes' end, "
    "case when length(filename) > 255 then 'filename_too_long' end), '') as message from lim)"
)
SCORED = f"{FEATURES}, {_score_sql(style.CONNECTOR_PHRASES)}"
RESULTS = {
    "original_length": "length(scored.text)",
    "n_invisible": "coalesce(removed_invisible, 0)",
    "n_keyword": "coalesce(removed_keyword, 0)",
    "total_findings": "coalesce(removed_invisible, 0) + coalesce(removed_keyword, 0)",
    "n_rows": "coalesce(removed_invisible, 0) + coalesce(removed_keyword, 0)",
    "clean": "counts.doc_id is null",
    "score": "score",
    "band": BAND.format("score"),
    "signals": SIGNALS,
}
JUDGED = (
    f"with {BODY}, {COUNTS}, {SCORED}, {files_sql()}, sized as (select batch, doc_id, count(*) over (partition by batch) as n_files, "
    "sum(bytes) over (partition by batch order by ord) as running_bytes from files), verdict as (select *, "
    "case when n_files > 17 then 'too_many_files' when running_bytes > 30000 then 'batch_budget_exceeded' end as message from sized), "
    "judged as (select batch, verdict.doc_id, message, case when message is null then 'ok' else 'error' end as status, "
    + ", ".join(f"case when message is null then {sql} end as {name}" for name, sql in RESULTS.items())
    + " from verdict join scored on scored.doc_id = verdict.doc_id left join counts on counts.doc_id = verdict.doc_id)"
)
PLACES = (
    "inv_places as (select doc_id, string_agg('inv:' || position || ':' || " + q.label("ord(m)") + ", ',' order by position) as "
    "invisible_places from inv group by doc_id), kw_places as (select doc_id, string_agg('kw:' || position || ':' || "
    "(position + length(m)) || ':' || keyword, ',' order by kw_ord, position) as keyword_places from kws group by doc_id)"
)
JOB = (
    f"with {BODY}, {COUNTS}, {SCORED}, {PLACES}, job as (select scored.doc_id, filename, "
    + ", ".join(f"{sql} as {name}" for name, sql in RESULTS.items() if name != "score")
    + ", score, coalesce(invisible_places, '') as invisible_places, coalesce(keyword_places, '') as keyword_places "
    "from scored join planted using (doc_id) left join counts on counts.doc_id = scored.doc_id "
    "left join inv_places on inv_places.doc_id = scored.doc_id left join kw_places on kw_places.doc_id = scored.doc_id)"
)
EXT = r"lower(regexp_extract(filename, '([.][^.]*)$', 1))"
KNOWN = ", ".join(f"'{e}'" for e in [*docs.TEXT_EXTENSIONS, ""])

QUERIES = {
    "sentence_split": (
        sentence_split,
        f"select doc_id, generate_subscripts(ss, 1) - 1 as n, unnest(ss) as sentence from "
        f"(select doc_id, {q.sentences('text')} as ss from documents)",
    ),
    "word_tokens": (
        word_tokens,
        f"with {P}, w as (select unnest(regexp_extract_all(text, '{q.WORD}')) as w from planted) "
        "select lower(w) as word, count(*) as n from w group by all",
    ),
    "style_features": (
        style_features,
        f"with {P}, {FEATURES} select doc_id, n_sentences, n_words, n_distinct_words, sum_len, sum_len_sq, n_period, "
        "sum_commas, sum_commas_sq from feat",
    ),
    "style_score": (
        style_score,
        f"with {P}, {FEATURES}, {_score_sql(style.CONNECTOR_PHRASES)} select doc_id, length_points::bigint as length_points, "
        "diversity_points::bigint as diversity_points, phrase_points::bigint as phrase_points, "
        "punctuation_points::bigint as punctuation_points, max_points::bigint as max_points, score, "
        f"{SIGNALS} as signals, array_to_string(ph, ',') as phrases, {BAND.format('score')} as band from scored",
    ),
    "phrase_presence": (
        phrase_presence,
        f"with {prose_sql()}, p as (select unnest(list_filter([{', '.join(chr(39) + p + chr(39) for p in style.CONNECTOR_PHRASES)}], "
        "lambda p: contains(lower(text), p))) as phrase from prose) select phrase, count(*) as n_docs from p group by phrase",
    ),
    "custom_phrases": (
        custom_phrases,
        f"with {P}, p as (select doc_id, list_filter([{', '.join(chr(39) + p + chr(39) for p in CUSTOM)}], "
        "lambda p: contains(lower(text), p)) as ph from planted) select doc_id, least(30, 10 * len(ph))::bigint as phrase_points, "
        "array_to_string(ph, '|') as phrases from p",
    ),
    "sentence_statistics": (
        sentence_statistics,
        f"with planted as (select doc_id, text from documents), {FEATURES}, "
        f"per as (select doc_id, {q.word_count('s')} as w from (select doc_id, unnest(ss) as s from sent)), "
        "agg as (select doc_id, round(avg(w), 6) as mean_len, round(stddev_pop(w), 6) as stdev_len from per group by doc_id) "
        "select doc_id, mean_len, stdev_len, round(n_distinct_words / nullif(n_words, 0), 6) as type_token "
        "from feat left join agg using (doc_id)",
    ),
    "score_before_after": (
        score_before_after,
        f"with {BASE}, {_two_scores('base', 'text', f'regexp_replace(text, {chr(39)}{q.FLAGGED}{chr(39)}, {chr(39)*2}, {chr(39)}g{chr(39)})')} "
        "select doc_id, score_before, score_after, round(score_after - score_before, 1) as delta, "
        "case when round(score_after - score_before, 1) > 0 then 'up' when round(score_after - score_before, 1) < 0 then 'down' "
        "else 'flat' end as direction from pair",
    ),
    "band_transitions": (
        band_transitions,
        f"with {prose_sql()}, {_two_scores('prose', 'text', CHANGED)}, "
        f"b as (select {BAND.format('score_before')} as band_before, {BAND.format('score_after')} as a from pair) "
        "select band_before, count(*) filter (a = 'low') as low, count(*) filter (a = 'medium') as medium, "
        "count(*) filter (a = 'high') as high from b group by band_before",
    ),
    "validation": (
        validation,
        f"with {P}, {LIMITED} select doc_id, case when message is null then 'ok' else 'error' end as status, message from broken",
    ),
    "quarantine": (
        quarantine,
        f"with {P}, {LIMITED} select message, count(*) as n from broken where message is not null group by message",
    ),
    "batch_file_cap": (
        batch_file_cap,
        f"with {P}, {files_sql()}, sized as (select batch, doc_id, count(*) over (partition by batch) > 17 as over_cap from files) "
        "select batch, doc_id, case when over_cap then 'error' else 'ok' end as status, "
        "case when over_cap then 'too_many_files' end as message from sized",
    ),
    "batch_budget": (
        batch_budget,
        f"with {P}, {files_sql()}, meta as (select doc_id, case when doc_id % 10 = 7 then null else batch end as batch, "
        "case when doc_id = 3 then null else ord end as ord, bytes from files), totals as (select *, cast(sum(bytes) over "
        "(partition by batch order by ord nulls first) as bigint) as running_bytes from meta) "
        "select doc_id, batch, ord, bytes, running_bytes, case when running_bytes > 40000 then 'error' else 'ok' end as status, "
        "case when running_bytes > 40000 then 'batch_budget_exceeded' end as message from totals",
    ),
    "batch_scan": (batch_scan, f"{JUDGED} select * from judged"),
    "scan_corpus": (
        scan_corpus,
        f"{JOB} select doc_id, 'pasted_text.txt' as filename, 'txt' as file_type, original_length, n_invisible, n_keyword, "
        "total_findings, clean, score, band, signals, invisible_places, keyword_places from job",
    ),
    "nested_results": (
        nested_results,
        f"{JOB} select doc_id, coalesce(filename, 'x') as filename, original_length, total_findings, clean, score, signals, "
        "invisible_places, keyword_places from job",
    ),
    "batch_summary": (
        batch_summary,
        f"{JUDGED} select batch, count(*) as n_files, count(*) filter (status = 'error') as n_errors, "
        "cast(coalesce(sum(total_findings), 0) as bigint) as total_findings from judged group by batch",
    ),
    "file_routing": (
        file_routing,
        f"with {P}, names as (select coalesce(filename, '') as filename from planted union all select url from pages), "
        f"e as (select {EXT} as ext from names) select ext, case when ltrim(ext, '.') = '' and ext in ({KNOWN}) then 'text' "
        "else ltrim(ext, '.') end as label, case when ext = '.pdf' then 'pdf' when ext = '.docx' then 'docx' "
        f"when ext in ({KNOWN}) then 'text' else 'unknown_as_text' end as route, count(*) as n from e group by all",
    ),
    "bytes_fallback": (
        bytes_fallback,
        r"select doc_id, case when doc_id % 3 = 0 and lang = 'es' then regexp_replace(text, '[^\x{0}-\x{FF}]', '?', 'g') "
        "when doc_id % 5 = 0 then chr(65279) || text else text end as text from documents",
    ),
    "fragment_assembly": (
        fragment_assembly,
        "select conv_id, string_agg(case when turn % 5 <> 3 then coalesce(text, '') else '' end, chr(10) order by turn, "
        "case when turn % 5 <> 3 then coalesce(text, '') else '' end) as text, count(*) as n_fragments "
        "from conversations group by conv_id",
    ),
    "keyword_fields": (
        keyword_fields,
        f"with k as (select doc_id, generate_subscripts(ks, 1) as kw_ord, unnest(ks) as keyword from (select doc_id, "
        f"list_transform(list_filter(string_split(replace(text, ' ', ','), ','), lambda x: {q.strip('x')} <> ''), "
        f"lambda x: {q.strip('x')}) as ks from documents)) select doc_id, kw_ord, keyword, kw_ord <= 100 as within_limit from k",
    ),
    "ranked_keywords": (
        ranked_keywords,
        "select event_type, kw_ord, keyword, kw_ord <= 100 as within_limit from (select event_type, row_number() over "
        "(partition by event_type order by event_id) as kw_ord, props as keyword from events)",
    ),
    "default_filenames": (
        default_filenames,
        f"with {P} select coalesce(filename, 'pasted_text.txt') as filename, count(*) as n from planted group by 1",
    ),
    "scanned_files": (
        scanned_files,
        f"with {P}, placed as (select source, strlen(text) + 1 as size, "
        "sum(strlen(text) + 1) over (partition by source order by doc_id) as done from planted) "
        f"select source, 'txt' as file_type, count(distinct (done - size) // {PACK}) as n_files, "
        "cast(sum(size) as bigint) as bytes from placed group by source",
    ),
    "file_findings": (
        file_findings,
        f"with {BODY}, {COUNTS} select source, 'ok' as status, 'txt' as file_type, "
        "cast(sum(coalesce(removed_invisible, 0)) as bigint) as n_invisible, "
        "cast(sum(coalesce(removed_keyword, 0)) as bigint) as n_keyword, cast(sum(length(text) + 1) as bigint) as original_length, "
        "0 as n_clean from planted left join counts using (doc_id) group by source",
    ),
}
