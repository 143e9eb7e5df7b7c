"""Test corpora planted on the shared tables, written once for Spark and once for plain SQL.

The shared tables hold no invisible characters, stock phrases or code, so each
row gets some as a pure function of its id; the whole table and whole texts are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsa.functions.arrays import sql_literal
from palimpsa.sources.documents import read_documents

PLANTED = [0x200B, 0x2028, 0xE0041, 0xAD, 0xA0, 0xFEFF, 0x202E, 0xFFFE, 0x2009, 0x3000]

FILENAMES = ["'r_' || doc_id || '.TXT'", "'notes.md'", "'pack.tar.gz'", "'scan.pdf'", "'README'", "cast(null as {s})"]

PASSAGES = [
    "El puente fue construido por los obreros. Es bueno. Va bien. Todo cuadra ya. Nada falta.",
    "Es importante destacar que el equipo puede mejorar el resultado del proyecto, pero la junta directiva pidió "
    "además una revisión completa de los anexos, que nadie leyó, y el comité aceptó la propuesta sin cambios.",
    "- uno muy bueno\n- dos por lo tanto\n- tres",
    "La ley fue aprobada por el senado. El texto fue traducido por la editorial. Muy breve. Quizás. Fin.",
    "Cabe destacar que es crucial. El informe anual de la empresa describe con detalle cada uno de los gastos "
    "mientras que el resumen ejecutivo apenas menciona los ingresos totales del ejercicio pasado.",
    "También es posible hacer esto. Por otro lado, nadie lo hizo porque no obstante era muy grande.\n \n\nOtra parte.",
]

SNIPPETS = [
    ("import os\n# Nota importante: revisar\nurl = \"http://x/#frag\"  # nota: final\n", "a.py"),
    ("var u = 'http://x//y'; // Note: tail\n/* uno\ndos */ var z = 1;\n", "b.js"),
    ("<!DOCTYPE html><!-- nota: cabecera\notra --><p>x</p>\n", None),
    ("SELECT 1 -- importante: clave\n/* fin */ FROM t;\n", "q.SQL"),
    ("fn main() -> i32 { // This function is responsible for all\n 0 }\n", None),
    ("package main\nfunc main() { /* Esta función se encarga de sumar */ }\n", None),
    ("a { color: red; } /* Observación: tono */\n", "s.scss"),
    ("<?php echo 'it\\'s // no'; // atención: si\n", None),
    ("public class A { String s = \"/* no */\"; /* Este método vale */ }\n", "noext"),
    ("x: 1 # esta clase se encarga de leer\ny: 'a # b'\n", "c.yml"),
]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(spark, f"{sf_dir}/documents.parquet")


def _pick(values: list[str], index: str) -> str:
    whens = " ".join(f"when {i} then {v}" for i, v in enumerate(values))
    return f"case {index} {whens} end"


def _prefix() -> str:
    return (
        "case when doc_id % 35 = 0 then 'Cabe destacar que es crucial. ' else '' end || "
        "case when doc_id % 5 = 0 then 'En resumen, ' else '' end || "
        "case when doc_id % 7 = 0 then 'Por lo tanto, ' else '' end"
    )


def _suffix() -> str:
    return (
        "case when doc_id % 3 = 0 then ' WM-' || lpad(cast(doc_id % 10000 as {s}), 4, '0') else '' end || "
        "case when doc_id % 4 = 0 then ' CONFIDENTIAL' else '' end"
    )


def _marked(chars: str, newline: str, place: str = "(doc_id * 37) % n_chars") -> str:
    at = f"cast({place} as int)"
    return (
        f"case when doc_id % 11 = 0 then text else substr(text, 1, {at}) || {chars} || substr(text, {at} + 1) "
        f"|| {newline} || {chars} || {chars} end"
    )


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with invisible characters, keywords and stock phrases.

    A document of no characters has no place for one, so its text is null; a large id may not overflow.
    """
    base = documents(spark, sf_dir)
    chars = _pick([f"'{chr(c)}'" for c in PLANTED], "doc_id % 10")
    place = "try_mod(try_mod(doc_id, n_chars) * 37, n_chars)"
    text = f"{_prefix()} || ({_marked(chars, sql_literal(chr(10)), place)}) || {_suffix()}".format(s="string")
    return base.selectExpr(
        "doc_id", "source", "lang", _pick(FILENAMES, "doc_id % 6").format(s="string") + " as filename", f"{text} as text"
    )


def marked_sql() -> str:
    chars = _pick([f"chr({c})" for c in PLANTED], "doc_id % 10")
    text = f"{_prefix()} || ({_marked(chars, 'chr(10)')}) || {_suffix()}".format(s="varchar")
    names = _pick(FILENAMES, "doc_id % 6").format(s="varchar")
    return f"planted as (select doc_id, source, lang, {names} as filename, {text} as text from documents)"


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after a Spanish passage with phrases, lists, passives, short and long sentences."""
    base = documents(spark, sf_dir)
    passage = _pick([sql_literal(p) for p in PASSAGES], "doc_id % 6")
    return base.selectExpr("doc_id", "source", f"{passage} || '\\n\\n' || text as text")


def prose_sql() -> str:
    passage = _pick(["'" + p.replace("'", "''") + "'" for p in PASSAGES], "doc_id % 6")
    return f"prose as (select doc_id, source, {passage} || chr(10) || chr(10) || text as text from documents)"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source texts: a snippet followed by the document, every third one as a block comment."""
    base = documents(spark, sf_dir)
    code = _pick([sql_literal(c) for c, _ in SNIPPETS], "doc_id % 10")
    names = _pick(["cast(null as string)" if n is None else f"'{n}'" for _, n in SNIPPETS], "doc_id % 10")
    body = "case when doc_id % 3 = 0 then '/* ' || text || ' */' else text end"
    return base.selectExpr("doc_id", f"{names} as filename", f"{code} || {body} as code")


def sources_sql() -> str:
    code = _pick(["'" + c.replace("'", "''") + "'" for c, _ in SNIPPETS], "doc_id % 10")
    names = _pick(["cast(null as varchar)" if n is None else f"'{n}'" for _, n in SNIPPETS], "doc_id % 10")
    body = "case when doc_id % 3 = 0 then '/* ' || text || ' */' else text end"
    return f"sources as (select doc_id, {names} as filename, {code} || {body} as code from documents)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked documents as batched files; one batch holds a third of all rows."""
    return marked(spark, sf_dir).selectExpr(
        "*", "case when doc_id % 3 = 0 then 0L else 1 + doc_id div 25 end as batch", "doc_id as ord",
        "cast(octet_length(text) as bigint) as bytes",
    )


def files_sql() -> str:
    return (
        "files as (select *, case when doc_id % 3 = 0 then 0 else 1 + doc_id // 25 end as batch, doc_id as ord, "
        "strlen(text) as bytes from planted)"
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_numbers(frame: DataFrame) -> DataFrame:
    """One width for whole numbers, so results compare equal across engines."""
    return frame.select(
        *[F.col(n).cast("bigint").alias(n) if t in ("int", "smallint") else F.col(n) for n, t in frame.dtypes]
    )
