"""The registered queries of this subpackage, each over its whole table, next to plain SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsa.llm import dialogue, exact, jaccard, katz, langid, leaks, merkle, pieces, pii, sharding, suffixes, toxicity, urls
from palimpsa.llm.common import remainder, table

# A public vocabulary file; the path is a parameter of the query.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"

# Host labels of the listed sites.
LISTED_WORDS = ("spam", "pills", "casino")


def url_listing(pages: DataFrame) -> DataFrame:
    """Canonical urls of the pages on sites whose host names a listed word."""
    host, path = urls.host_of("url"), urls.path_of("url")
    named = host.rlike("|".join(LISTED_WORDS))
    return pages.filter(named).select(urls.canonical(host, path).alias("listed_url"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge_urls(pages, url_listing(pages))


OP1_SQL = r"""
with cut as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), parts as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut
), rules(rule, action) as (
  values ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'),
    ('net/fr/', 'block')
), ruled as (
  select page_id, host, path, (select rule from rules r where (host = split_part(rule, '/', 1)
      or ends_with(host, '.' || split_part(rule, '/', 1))) and starts_with(path, substr(rule, instr(rule, '/')))
    order by length(rule) desc limit 1) as rule from parts
), judged as (
  select page_id, host, path, r.rule, r.action, regexp_matches(host, 'spam|pills|casino') as listed
  from ruled left join rules r using (rule)
)
select page_id, host, path, rule, coalesce(action, case when listed then 'block' else 'allow' end) as verdict, listed
from judged
"""


def _written(spans: Column) -> Column:
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, line), ",")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.add_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in pii.BASE_KINDS],
        F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"),
        _written(F.col("pii")).alias("spans"),
        F.array_max(F.transform("pii", lambda s: s["score"])).alias("top_score"),
    )


def op3_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str = MODEL_FILE) -> DataFrame:
    model = pieces.load_model(model_file)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.decode(pieces.encode(docs, model), model)
    return coded.select(
        "doc_id", "pieces", F.size("pieces").alias("n_pieces"),
        F.sha2(F.coalesce("decoded", F.lit("")).cast("binary"), 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("restored"),
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder("doc_id", 3) == 1
    model = langid.fit_languages(docs.filter(~held_out))
    return langid.add_language(docs.drop("lang"), model).select(
        "doc_id", held_out.alias("held_out"), F.col("language.name").alias("lang_pred"),
        F.col("language.score").alias("score"),
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"), digest_all=True)


OP7_SQL = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
  doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))
"""

def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_classes(table(spark, sf_dir, "documents"), words=3, similarity=(90, 100))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder("doc_id", 4) == 2
    model = toxicity.fit_from_labels(docs.filter(~held_out), table(spark, sf_dir, "labels"))
    scored = toxicity.add_toxicity(docs, model, into="score")
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = F.translate("text", urls.UPPER, urls.LOWER)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.audit(docs, "doc_id", "source", fields, {"text": lowered}, tampered)


OP11_SQL = r"""
with recursive fields as (
  select doc_id, source, text, concat(coalesce(concat(strlen(doc_id::varchar), ':', doc_id), '-'),
    coalesce(concat(strlen(source), ':', source), '-'), coalesce(concat(strlen(lang), ':', lang), '-'),
    coalesce(concat(strlen(n_chars::varchar), ':', n_chars), '-')) as head from documents
), leaves as (
  select *, sha256(head || coalesce(concat(strlen(text), ':', text), '-')) as leaf,
    sha256(head || coalesce(concat(strlen(text), ':', translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz')), '-')) as lowered from fields
), placed as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos,
    count(*) over (partition by source) as n from leaves
), inner_nodes as (
  select 0 as level, source, pos, n, leaf as node from placed
  union all
  select level + 1, source, pos // 16, (n + 15) // 16, sha256(string_agg(node, '' order by pos))
  from inner_nodes where n > 1 group by level, source, pos // 16, (n + 15) // 16
), subroots as (
  select source, node, row_number() over (order by source nulls first) - 1 as pos, count(*) over () as n
  from inner_nodes where n = 1
), outer_nodes as (
  select 0 as level, pos, n, node from subroots
  union all
  select level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(node, '' order by pos))
  from outer_nodes where n > 1 group by level, pos // 16, (n + 15) // 16
), inner_runs as (
  select level, source, pos // 16 as run, list(node order by pos) as nodes from inner_nodes where n > 1
  group by level, source, pos // 16
), outer_runs as (
  select level, pos // 16 as run, list(node order by pos) as nodes from outer_nodes where n > 1 group by level, pos // 16
), crc(byte, value) as (
  select byte, step8 from (select range as byte, range as step0 from range(256)),
    lateral (select if(step0 % 2 = 1, xor(step0 >> 1, 3988292384), step0 >> 1) as step1),
    lateral (select if(step1 % 2 = 1, xor(step1 >> 1, 3988292384), step1 >> 1) as step2),
    lateral (select if(step2 % 2 = 1, xor(step2 >> 1, 3988292384), step2 >> 1) as step3),
    lateral (select if(step3 % 2 = 1, xor(step3 >> 1, 3988292384), step3 >> 1) as step4),
    lateral (select if(step4 % 2 = 1, xor(step4 >> 1, 3988292384), step4 >> 1) as step5),
    lateral (select if(step5 % 2 = 1, xor(step5 >> 1, 3988292384), step5 >> 1) as step6),
    lateral (select if(step6 % 2 = 1, xor(step6 >> 1, 3988292384), step6 >> 1) as step7),
    lateral (select if(step7 % 2 = 1, xor(step7 >> 1, 3988292384), step7 >> 1) as step8)
), ids as (
  select doc_id, doc_id::varchar as letters, 0 as done, 4294967295 as state
  from (select distinct doc_id from documents where doc_id is not null)
  union all
  select doc_id, letters, done + 1, xor(state >> 8, value)
  from ids join crc on byte = xor(state & 255, ascii(letters[done + 1])) where done < length(letters)
), tampered as (
  select distinct doc_id from ids where done = length(letters) and xor(state, 4294967295) % 5 = 0
), climbed as (
  select row_number() over () as row, doc_id, source, leaf, 0 as level, pos, n,
    if(doc_id in (select doc_id from tampered), lowered, leaf) as folded, '' as proof from placed
  union all
  select row, doc_id, c.source, leaf, c.level + 1, pos // 16, (n + 15) // 16,
    sha256(concat(array_to_string(nodes[:pos % 16], ''), folded, array_to_string(nodes[pos % 16 + 2:], ''))),
    concat(proof, array_to_string(nodes[:pos % 16], ''), array_to_string(nodes[pos % 16 + 2:], ''))
  from climbed c join inner_runs r on r.level = c.level and r.source is not distinct from c.source and r.run = pos // 16
  where n > 1
), grown as (
  select row, doc_id, leaf, s.node as subroot, 0 as level, s.pos, s.n, folded, proof
  from climbed c join subroots s on s.source is not distinct from c.source where c.n = 1
  union all
  select row, doc_id, leaf, subroot, g.level + 1, pos // 16, (n + 15) // 16,
    sha256(concat(array_to_string(nodes[:pos % 16], ''), folded, array_to_string(nodes[pos % 16 + 2:], ''))),
    concat(proof, array_to_string(nodes[:pos % 16], ''), array_to_string(nodes[pos % 16 + 2:], ''))
  from grown g join outer_runs r on r.level = g.level and r.run = pos // 16 where n > 1
)
select doc_id, leaf, subroot, o.node as root, sha256(proof) as proof_sha256, folded as folded_root,
  folded = o.node as verified
from grown g cross join (select node from outer_nodes where n = 1) o where g.n = 1
"""


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_texts(table(spark, sf_dir, "documents"), held_out=remainder("doc_id", 7) == 2)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair_conversations(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_url_filter": (op1_url_filter, OP1_SQL),
    "op2_personal_data": (op2_personal_data, None),
    "op3_sentencepiece": (op3_sentencepiece, None),
    "op4_suffix_dedup": (op4_suffix_dedup, None),
    "op5_language": (op5_language, None),
    "op6_sharding": (op6_sharding, None),
    "op7_exact_dedup": (op7_exact_dedup, OP7_SQL),
    "op8_ngram_jaccard": (op8_ngram_jaccard, None),
    "op9_benchmark_decontamination": (op9_benchmark_decontamination, None),
    "op10_toxicity": (op10_toxicity, None),
    "op11_merkle_manifest": (op11_merkle_manifest, OP11_SQL),
    "op12_lm_scoring": (op12_lm_scoring, None),
    "op13_conversation_repair": (op13_conversation_repair, None),
}
