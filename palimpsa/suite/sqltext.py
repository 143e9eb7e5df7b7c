"""Fragments of plain SQL for the checks; written apart from the Spark side on purpose."""

from __future__ import annotations

from palimpsa.functions import chars

FLAGGED = (
    r"[\x{AD}\x{61C}\x{180E}\x{200B}-\x{200F}\x{2028}-\x{202E}\x{2060}-\x{2064}\x{FEFF}"
    r"\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{E0000}-\x{E007F}\x{FFFE}\x{FFFF}]"
)
WS = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LETTER = r"[\p{L}\p{Nl}\p{No}]"
WORD = rf"{LETTER}+(?:''{LETTER}+)?"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sentences(x: str) -> str:
    marked = rf"string_split(regexp_replace({strip(x)}, '([.!?]){WS}+', '\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({marked}, lambda s: {strip('s')}), lambda s: s <> '')"


def raw_sentences(x: str) -> str:
    marked = rf"string_split(regexp_replace({strip(x)}, '([.!?]){WS}+', '\1' || chr(1), 'g'), chr(1))"
    return f"list_filter({marked}, lambda s: s <> '')"


def word_count(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{WORD}'))"


def sites(source: str, text: str, pattern: str, key: str = "doc_id") -> str:
    """Rows (key, i, m, position) of all matches, by running lengths of the pieces between them."""
    return f"""select {key}, i, m,
      cast(sum(length(s) + length(m)) over (partition by {key} order by i) - length(m) as bigint) as position
      from (select {key}, generate_subscripts(ms, 1) as i, unnest(ms) as m, unnest(ss[1:len(ms)]) as s
            from (select {key}, regexp_extract_all({text}, '{pattern}') as ms,
                         string_split_regex({text}, '{pattern}') as ss from {source}))"""


def lines(position: str = "position", text: str = "text") -> str:
    before = f"substr({text}, 1, cast({position} as int))"
    return (
        f"cast(length({before}) - length(replace({before}, chr(10), '')) + 1 as bigint) as line, "
        f"cast(length({before}) - coalesce(length({before}) - strpos(reverse({before}), chr(10)) + 1, 0) "
        f"* cast(contains({before}, chr(10)) as int) + 1 as bigint) as \"column\""
    )


def name_table() -> str:
    rows = [f"({cp}, '{name}', '{kind}')" for cp, name, kind in chars.singles()]
    tags = f"select 917504 + r as cp, '{chars.TAG_NAME}' as name, 'tag' as class from range(128) t(r)"
    return f"names as (select * from (values {', '.join(rows)}) v(cp, name, class) union all {tags})"


def label(cp: str) -> str:
    return f"'U+' || case when {cp} < 65536 then lpad(hex({cp}), 4, '0') else hex({cp}) end"


def invisible() -> str:
    """Needs planted; gives inv(doc_id, i, m, position)."""
    return f"inv as ({sites('planted', 'text', FLAGGED)})"


def keywords(pairs: list[tuple[int, str, str]]) -> str:
    """Needs planted; gives kws(doc_id, kw_ord, keyword, m, position) for (ordinal, keyword, pattern)."""
    parts = [
        f"select doc_id, {n} as kw_ord, '{k}' as keyword, m, position from ({sites('planted', 'text', p)})"
        for n, k, p in pairs
    ]
    return f"kws as ({' union all '.join(parts)})"


def islands(spans: str) -> str:
    """From a relation (doc_id, s, e): isl(doc_id, s, e), disjoint and sorted, touching spans joined."""
    return f"""reach as (select doc_id, s, e, max(e) over (partition by doc_id order by s, e
        rows between unbounded preceding and 1 preceding) as prev from {spans}),
      numbered as (select *, sum(case when prev is null or s > prev then 1 else 0 end)
        over (partition by doc_id order by s, e rows unbounded preceding) as g from reach),
      isl as (select doc_id, cast(min(s) as bigint) as s, cast(max(e) as bigint) as e from numbered group by doc_id, g)"""


def segments(text_source: str = "planted") -> str:
    """Needs isl; gives seg(doc_id, s, e, kept, gone): text kept before each island, then the island."""
    return f"""bounds as (select doc_id, s, e from isl union all select doc_id, length(text), length(text) from {text_source}),
      placed as (select doc_id, s, e, coalesce(lag(e) over (partition by doc_id order by s, e), 0) as p,
        row_number() over (partition by doc_id order by s, e) as k from bounds),
      seg as (select doc_id, k, p, s, substr(text, cast(p as int) + 1, cast(s - p as int)) as kept,
        substr(text, cast(s as int) + 1, cast(e - s as int)) as gone from placed join {text_source} using (doc_id))"""


def escape(x: str) -> str:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{raw}', '{entity}')"
    return x
