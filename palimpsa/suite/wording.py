"""Lexicon queries with their plain-SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsa.functions.arrays import let
from palimpsa.functions.draws import text_seed, threshold
from palimpsa.functions.phrases import (
    INTENSITIES,
    IRREGULAR_PARTICIPLES,
    SPLIT_STARTERS,
    SPLIT_STOP_WORDS,
    STOCK_PHRASES,
    SYNONYMS,
)
from palimpsa.functions.texts import word_count
from palimpsa.operators import lexicon
from palimpsa.operators.detect import rows_of
from palimpsa.plans import jobs
from palimpsa.suite import sqltext as q
from palimpsa.suite.corpus import prose, prose_sql

ALL_PHRASES = [*STOCK_PHRASES, *SYNONYMS]
R = prose_sql()


def phrase_sites(spark, sf_dir):
    found = prose(spark, sf_dir).select("doc_id", lexicon.phrase_sites(F.col("text"), ALL_PHRASES).alias("_m"))
    return rows_of(found, ("doc_id",), "_m").select("doc_id", "position", "matched")


def phrase_audit(spark, sf_dir):
    return lexicon.phrase_audit(prose(spark, sf_dir), ALL_PHRASES)


def top_phrases(spark, sf_dir):
    return lexicon.phrase_audit(prose(spark, sf_dir), ALL_PHRASES).orderBy(F.desc("n_sites"), "phrase").limit(10)


def text_seeds(spark, sf_dir):
    return prose(spark, sf_dir).select("doc_id", text_seed(F.col("text"), F.lit("medium")).alias("seed"))


def phrase_substitution(spark, sf_dir):
    seeded = prose(spark, sf_dir).withColumn("seed", text_seed(F.col("text"), F.lit("low")))
    done = seeded.select(
        "doc_id",
        lexicon.substitute(
            F.col("text"), STOCK_PHRASES, F.lit(threshold(0.70)), F.col("seed"), "phrase", repair=True
        ).alias("r"),
    )
    return done.select("doc_id", F.col("r.text").alias("rewritten"), F.col("r.n").alias("n_replaced"))


def synonym_substitution(spark, sf_dir):
    seeded = prose(spark, sf_dir).withColumn("seed", text_seed(F.col("text"), F.lit("high")))
    done = seeded.select(
        "doc_id",
        lexicon.substitute(F.col("text"), SYNONYMS, F.lit(threshold(0.45)), F.col("seed"), "synonym").alias("r"),
    )
    return done.select("doc_id", F.col("r.text").alias("rewritten"), F.col("r.n").alias("n_replaced"))


def intensity_parameters(spark, sf_dir):
    """Per-row parameters by a join with the three fixed rows."""
    asked = prose(spark, sf_dir).selectExpr("doc_id", "elt(1 + cast(doc_id % 3 as int), 'low', 'medium', 'high') as intensity")
    return asked.join(F.broadcast(lexicon.intensity_table(spark)), "intensity")


def paragraph_ordinals(spark, sf_dir):
    return lexicon.paragraph_table(prose(spark, sf_dir)).select("doc_id", "par", "paragraph", "ordinal")


def bullet_paragraphs(spark, sf_dir):
    return lexicon.paragraph_table(prose(spark, sf_dir)).select("doc_id", "par", "is_bullet")


def short_pairs(spark, sf_dir):
    pairs = lexicon.sentence_table(prose(spark, sf_dir)).filter("words <= 7 and next_words <= 7")
    return pairs.select("doc_id", "par", "sent", "words", "next_words")


def _sentence_arrays(spark, sf_dir):
    par = lexicon.paragraph_table(prose(spark, sf_dir)).filter("ordinal is not null and not is_bullet")
    return par.select(
        "doc_id", "par", lexicon.raw_sentences(F.col("paragraph")).alias("s"),
        F.concat_ws(":", "doc_id", "par").alias("seed"),
    )


def exact_sampling(spark, sf_dir):
    flagged = _sentence_arrays(spark, sf_dir).select(
        "doc_id",
        "par",
        let(
            let(F.transform("s", word_count), lambda counts: lexicon.short_pairs(counts, 9)),
            lambda e: let(
                lexicon.sample_exact(e, 0.34, F.col("seed"), "merge"),
                lambda c: let(
                    lexicon.merge_flags(c),
                    lambda m: F.transform(c, lambda x, i: F.struct(x.alias("chosen"), F.get(m, i).alias("merges"))),
                ),
            ),
        ).alias("_f"),
    )
    return rows_of(flagged, ("doc_id", "par"), "_f", "sent").filter("chosen").select("doc_id", "par", "sent", "merges")


def pair_merge(spark, sf_dir):
    merged = _sentence_arrays(spark, sf_dir).select(
        "doc_id", "par", lexicon.merge_short(F.col("s"), 0.34, 9, F.col("seed")).alias("m")
    )
    return merged.select("doc_id", "par", F.array_join("m.s", " ").alias("merged"), F.col("m.n").alias("n_merged"))


def split_points(spark, sf_dir):
    long = lexicon.sentence_table(prose(spark, sf_dir)).filter("words > 15")
    cut = long.withColumn("p", lexicon.split_point(F.col("sentence"))).filter("p.position is not null")
    halves = cut.withColumn("h", lexicon.split_at(F.col("sentence"), F.col("p")))
    return halves.select(
        "doc_id", "par", "sent", "p.position", F.col("h")[0].alias("first"), F.col("h")[1].alias("second")
    )


def passive_candidates(spark, sf_dir):
    return lexicon.passive_candidates(prose(spark, sf_dir))


def length_drift(spark, sf_dir):
    """Which rewrites would leave the length budget, and whether they were retried."""
    done = lexicon.rewrite(prose(spark, sf_dir), "high")
    return done.select(
        "doc_id", lexicon.length_budget(F.col("text")).alias("budget"), "retried",
        (F.abs(F.length("rewritten") - F.length("text")) <= lexicon.length_budget(F.col("text"))).alias("within"),
    )


def change_summary(spark, sf_dir):
    return lexicon.change_summary(lexicon.rewrite(prose(spark, sf_dir), "medium"))


def rewrite_corpus(spark, sf_dir):
    return jobs.rewrite_corpus(prose(spark, sf_dir), "medium").select(
        "doc_id", "rewritten", "is_rewritten", "n_phrase", "n_synonym", "n_merge", "n_split", "score_before",
        "score_after", "delta",
    )


def _plain(word: str) -> str:
    return word.translate(str.maketrans("áéíóúñü", "AEIOUNW"))


def _ascii(x: str) -> str:
    """Lower case, accents of the phrases as capitals, other letters and digits as Z: ASCII word boundaries suffice."""
    return (
        f"regexp_replace(regexp_replace(translate(lower({x}), 'áéíóúñü', 'AEIOUNW'), "
        r"'[^\x00-\x7F\PL]', 'Z', 'g'), '[^\x00-\x7F\PN]', 'Z', 'g')"
    )


def _phrase_sites(phrases) -> str:
    ordered = sorted(phrases, key=len, reverse=True)
    pattern = r"\b(?:" + "|".join(_plain(p) for p in ordered) + r")\b"
    return (
        f"found as (select doc_id, i, position, substr(text, cast(position as int) + 1, cast(length(m) as int)) as m, text "
        f"from ({q.sites('prose', _ascii('text'), pattern)}) join prose using (doc_id))"
    )


def _draw(keys: str) -> str:
    return f"cast('0x' || substr(md5({keys}), 1, 8) as bigint)"


def _substituted(dictionary, label: str, probability: float, salt: str, repair: bool) -> str:
    rows = ", ".join(
        f"('{k}', {i}, {len(v)}, {'null' if o is None else chr(39) + o + chr(39)})"
        for k, v in dictionary.items()
        for i, o in enumerate(v)
    )
    key = f"substr(sha256('{label}::' || text), 1, 16) || ':{salt}:' || (i - 1)"
    text = "coalesce(body, text)"
    if repair:
        tidy = q.strip("regexp_replace(body, ' {2,}', ' ', 'g')")
        text = f"case when n > 0 then {_capital_if(tidy, 'text')} else text end"
    return f"""with {R}, {_phrase_sites(dictionary)}, opts as (select * from (values {rows}) v(phrase, pick, n, opt)),
      drawn as (select *, {_draw(key)} <= {threshold(probability)} as hit, {_draw(key + " || ':pick'")} as d from found),
      chosen as (select f.*, case when not hit then m else coalesce({_capital_if('o.opt', 'm')}, '') end as r
        from drawn f left join opts o on o.phrase = lower(m) and o.pick = d % o.n),
      laid as (select *, coalesce(lag(position + length(m)) over (partition by doc_id order by i), 0) as p from chosen),
      built as (select doc_id, string_agg(substr(text, cast(p as int) + 1, cast(position - p as int)) || r, '' order by i) as head,
        max(position + length(m)) as fin, count(*) filter (hit) as n from laid group by doc_id),
      done as (select doc_id, text, head || substr(text, cast(fin as int) + 1) as body, coalesce(n, 0) as n
        from prose left join built using (doc_id))
      select doc_id, {text} as rewritten, n as n_replaced from done"""


def _capital_if(x: str, model: str) -> str:
    return (
        f"case when upper(substr({model}, 1, 1)) = substr({model}, 1, 1) and lower(substr({model}, 1, 1)) <> substr({model}, 1, 1) "
        f"then upper(substr({x}, 1, 1)) || substr({x}, 2) else {x} end"
    )


PAR = (
    rf"pars as (select doc_id, generate_subscripts(ps, 1) - 1 as par, unnest(ps) as paragraph from "
    rf"(select doc_id, string_split_regex(text, '\n{q.WS}*\n+') as ps from prose)), "
    f"lined as (select *, {q.strip('paragraph')} = '' as blank, list_filter(string_split(paragraph, chr(10)), "
    f"lambda l: {q.strip('l')} <> '') as ls from pars), "
    f"kinds as (select *, len(ls) >= 2 and len(list_filter(ls, lambda l: regexp_matches(l, "
    rf"'^{q.WS}*([-*•‣]|\p{{Nd}}+[.)]){q.WS}+'))) >= greatest(1, len(ls) // 2) as is_bullet, "
    "case when not blank then sum(cast(not blank as int)) over (partition by doc_id order by par) end as ordinal from lined)"
)
SENT = (
    f"{R}, {PAR}, sent as (select doc_id, par, generate_subscripts(ss, 1) - 1 as sent, unnest(ss) as sentence from (select doc_id, par, "
    f"{q.raw_sentences('paragraph')} as ss from kinds where not blank and not is_bullet)), "
    f"counted as (select *, {q.word_count('sentence')} as words from sent), "
    "led as (select *, lead(words) over (partition by doc_id, par order by sent) as next_words, "
    "lead(sentence) over (partition by doc_id, par order by sent) as next_sentence from counted)"
)
SAMPLED = (
    f"{SENT}, elig as (select *, {_draw("doc_id || ':' || par || ':merge:' || sent")} as d "
    "from led where words <= 9 and next_words <= 9), ranked as (select *, row_number() over (partition by doc_id, par order by d, sent) as rk, "
    "count(*) over (partition by doc_id, par) as n from elig), "
    "chosen as (select *, sent - row_number() over (partition by doc_id, par order by sent) as isl from ranked "
    "where rk <= greatest(1, round_even(n * 0.34::double, 0))), "
    "paired as (select *, row_number() over (partition by doc_id, par, isl order by sent) % 2 = 1 as merges from chosen)"
)
ROLL = _draw("l.doc_id || ':' || l.par || ':join:' || l.sent")
STOPS = ", ".join(f"'{w}'" for w in SPLIT_STOP_WORDS)
STARTS = ", ".join(f"'{w}'" for w in SPLIT_STARTERS)


def _rtrim(x: str) -> str:
    return f"regexp_replace({x}, '{q.WS}+$', '')"


# Upper case of ß is SS in Unicode's full mapping; this engine maps it to one letter.
UP = "replace(upper(substr({0}, 1, 1)), 'ẞ', 'SS') || substr({0}, 2)"
NAME = r"[\p{L}\p{N}_]"
PASSIVE = (
    rf"([A-ZÁÉÍÓÚÑ]{NAME}*(?:{q.WS}+{NAME}+){{0,4}}){q.WS}+(fue|fueron){q.WS}+"
    rf"([a-záéíóúñ]+(?:ados|adas|ado|ada|idos|idas|ido|ida)){q.WS}+por{q.WS}+({NAME}+(?:{q.WS}+{NAME}+){{0,4}})"
)
PARAMS = ", ".join(
    f"('{n}', {p['synonym_p']}::double, {p['merge_p']}::double, {p['split_p']}::double, {p['passive_p']}::double, "
    f"{p['phrase_p']}::double, {p['merge_words']}::bigint, {p['split_words']}::bigint, {p['aside_p']}::double)"
    for n, p in INTENSITIES.items()
)

QUERIES = {
    "phrase_sites": (
        phrase_sites, f"with {R}, {_phrase_sites(ALL_PHRASES)} select doc_id, position, m as matched from found"
    ),
    "phrase_audit": (
        phrase_audit,
        f"with {R}, {_phrase_sites(ALL_PHRASES)} select lower(m) as phrase, count(*) as n_sites, "
        "count(distinct doc_id) as n_docs from found group by 1",
    ),
    "top_phrases": (
        top_phrases,
        f"with {R}, {_phrase_sites(ALL_PHRASES)} select lower(m) as phrase, count(*) as n_sites, "
        "count(distinct doc_id) as n_docs from found group by 1 order by n_sites desc, phrase limit 10",
    ),
    "text_seeds": (text_seeds, f"with {R} select doc_id, substr(sha256('medium::' || text), 1, 16) as seed from prose"),
    "phrase_substitution": (phrase_substitution, _substituted(STOCK_PHRASES, "low", 0.70, "phrase", True)),
    "synonym_substitution": (synonym_substitution, _substituted(SYNONYMS, "high", 0.45, "synonym", False)),
    "intensity_parameters": (
        intensity_parameters,
        f"with {R}, p as (select * from (values {PARAMS}) v(intensity, synonym_p, merge_p, split_p, passive_p, phrase_p, "
        "merge_words, split_words, aside_p)) select doc_id, p.* from prose join p on intensity = "
        "['low', 'medium', 'high'][1 + doc_id % 3]",
    ),
    "paragraph_ordinals": (
        paragraph_ordinals,
        f"with {R}, {PAR} select doc_id, par, paragraph, cast(ordinal as bigint) as ordinal from kinds",
    ),
    "bullet_paragraphs": (bullet_paragraphs, f"with {R}, {PAR} select doc_id, par, is_bullet from kinds"),
    "short_pairs": (
        short_pairs,
        f"with {SENT} select doc_id, par, sent, words, next_words from led where words <= 7 and next_words <= 7",
    ),
    "exact_sampling": (exact_sampling, f"with {SAMPLED} select doc_id, par, sent, merges from paired"),
    "pair_merge": (
        pair_merge,
        f"with {SAMPLED}, m as (select doc_id, par, sent from paired where merges), "
        f"out as (select l.doc_id, l.par, l.sent, case when m.sent is null then sentence else "
        f"regexp_replace({_rtrim('sentence')}, '[.!?]$', '') || case when {ROLL} < {threshold(0.2)} "
        f"then '; ' when {ROLL} < {threshold(0.35)} then ' y ' else ', ' end || "
        f"lower(substr({q.strip('next_sentence')}, 1, 1)) || substr({q.strip('next_sentence')}, 2) end as t, m.sent is not null as did "
        "from led l left join m on m.doc_id = l.doc_id and m.par = l.par and m.sent = l.sent "
        "left join m prev on prev.doc_id = l.doc_id and prev.par = l.par and prev.sent = l.sent - 1 where prev.sent is null) "
        "select doc_id, par, string_agg(t, ' ' order by sent) as merged, count(*) filter (did) as n_merged from out group by doc_id, par",
    ),
    "split_points": (
        split_points,
        f"with {SENT}, long as (select * from counted where words > 15), "
        "commas as (select doc_id, par, sent, sentence, words, generate_subscripts(ps, 1) as i, "
        "unnest(list_transform(ps, lambda p, k: list_sum(list_transform(ps[1:k], lambda x: length(x) + 1)) - 1)) as position "
        "from (select *, string_split(sentence, ',') as ps from long)), "
        f"tried as (select *, {q.word_count('substr(sentence, 1, cast(position as int))')} as a, "
        f"{q.word_count('substr(sentence, cast(position as int) + 2)')} as b, "
        f"lower(regexp_extract(substr(sentence, cast(position as int) + 2), '^{q.WS}*({q.LETTER}+)', 1)) as nxt "
        "from commas where position < length(sentence)), "
        f"best as (select doc_id, par, sent, min_by(position, [case when nxt in ({STARTS}) then 0 else 1 end, "
        f"abs(position - length(sentence) // 2), position]) as comma_at from tried where a >= 4 and b >= 4 and nxt not in ({STOPS}) group by 1, 2, 3), "
        "conn as (select doc_id, par, sent, sentence, "
        f"length(string_split_regex(sentence, '(?i){q.WS}mientras que{q.WS}')[1]) as c1, "
        f"length(string_split_regex(sentence, '(?i){q.WS}pero{q.WS}')[1]) as c2 from long), "
        f"fall as (select *, case when c1 < length(sentence) and {q.word_count('substr(sentence, 1, cast(c1 as int))')} >= 4 and "
        f"{q.word_count('substr(sentence, cast(c1 as int) + 1)')} >= 4 then c1 when c2 < length(sentence) and "
        f"{q.word_count('substr(sentence, 1, cast(c2 as int))')} >= 4 and {q.word_count('substr(sentence, cast(c2 as int) + 1)')} >= 4 then c2 end as c from conn), "
        "pos as (select f.doc_id, f.par, f.sent, sentence, comma_at, coalesce(comma_at, c) as position from fall f left join best b "
        "on b.doc_id = f.doc_id and b.par = f.par and b.sent = f.sent where coalesce(comma_at, c) is not null), "
        f"cut as (select *, {_rtrim('substr(sentence, 1, cast(position as int))')} as h, "
        f"{q.strip('substr(sentence, cast(position as int) + case when comma_at is null then 1 else 2 end)')} as t from pos) "
        "select doc_id, par, sent, cast(position as bigint) as position, case when comma_at is null then h else rtrim(h, ',') end || '.' as first, "
        f"{UP.format('t')} as second from cut",
    ),
    "passive_candidates": (
        passive_candidates,
        f"with {SENT}, g as (select doc_id, par, sent, {', '.join(f'{q.strip(f'regexp_extract(sentence, {chr(39)}{PASSIVE}{chr(39)}, {i})')} as {n}' for i, n in enumerate(['subject', 'aux', 'participle', 'agent'], 1))} "
        f"from sent where regexp_matches(sentence, '{PASSIVE}')), "
        f"n as (select *, lower(regexp_extract(agent, '^[^ ]+')) as art, regexp_matches(participle, '({'|'.join(IRREGULAR_PARTICIPLES)})$') as odd from g), "
        "v as (select *, case when odd then null when art in ('los', 'las', 'unos', 'unas') then "
        "regexp_replace(participle, '(ad|id)[oa]s?$', '') || case when regexp_matches(participle, 'ad[oa]s?$') then 'aron' else 'ieron' end "
        "when art in ('el', 'la', 'un', 'una', 'lo') then regexp_replace(participle, '(ad|id)[oa]s?$', '') || "
        "case when regexp_matches(participle, 'ad[oa]s?$') then 'ó' else 'ió' end end as verb from n) "
        f"select doc_id, par, sent, subject, aux, participle, agent, verb, case when verb is not null then {UP.format('agent')} || ' ' || verb || ' ' || "
        "case when upper(subject) = subject and lower(subject) <> subject then subject else lower(substr(subject, 1, 1)) || substr(subject, 2) end end as suggestion from v",
    ),
    "length_drift": (length_drift, None),
    "change_summary": (change_summary, None),
    "rewrite_corpus": (rewrite_corpus, None),
}
