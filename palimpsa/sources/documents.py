"""Document tables, ordered fragments and keyword lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsa.functions.texts import file_extension, strip
from palimpsa.operators.validate import running_total

# The name of a text without one, and the limit on keywords.
DEFAULT_FILENAME = "pasted_text.txt"
MAX_KEYWORDS = 100

DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

# Suffixes read as text without question.
TEXT_EXTENSIONS = [
    ".txt", ".md", ".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".cpp",
    ".c", ".h", ".hpp", ".go", ".rs", ".php", ".rb", ".cs", ".swift",
    ".kt", ".sh", ".sql", ".json", ".yaml", ".yml", ".html", ".css",
    ".xml", ".ini", ".cfg", ".toml",
]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Declared schema, never inferred; only the columns used later are read."""
    return spark.read.schema(DOCUMENT_SCHEMA).parquet(path)


def with_filename(documents: DataFrame, filename: Column | None = None) -> DataFrame:
    name = filename if filename is not None else F.lit(None).cast("string")
    return documents.withColumn("filename", F.coalesce(name, F.lit(DEFAULT_FILENAME)))


def file_label(filename: Column) -> Column:
    """Type label of a file: the suffix, or ``text`` without one."""
    bare = F.regexp_replace(file_extension(filename), r"\A\.+", "")
    known = file_extension(filename).isin(*TEXT_EXTENSIONS, "")
    return F.when(known & (bare == ""), "text").otherwise(bare)


def file_route(filename: Column) -> Column:
    """Which reader a file needs."""
    ext = file_extension(filename)
    return (
        F.when(ext == ".pdf", "pdf")
        .when(ext == ".docx", "docx")
        .when(ext.isin(*TEXT_EXTENSIONS, ""), "text")
        .otherwise("unknown_as_text")
    )


def assemble(fragments: DataFrame, key: str, order: list[str], text: str = "text", joiner: str = "\n") -> DataFrame:
    """One text per key from ordered fragments; a missing fragment counts as empty.

    The result is one string per key, so what is gathered is as large as the
    output row itself.
    """
    piece = F.struct(*[F.col(c) for c in order], F.coalesce(F.col(text), F.lit("")).alias("_piece"))
    gathered = fragments.groupBy(key).agg(F.sort_array(F.collect_list(piece)).alias("_pieces"))
    return gathered.select(
        key,
        F.array_join(F.transform("_pieces", lambda p: p["_piece"]), joiner).alias(text),
        F.size("_pieces").alias("n_fragments"),
    )


def keyword_rows(fields: DataFrame, key: str, field: str, limit: int = MAX_KEYWORDS) -> DataFrame:
    """All keywords of a comma-separated field, trimmed, blanks dropped, in their order.

    ``within_limit`` tells the first ``limit`` of a field from the rest; to cut there is the caller's choice.
    """
    usable = F.filter(F.split(F.col(field), ","), lambda k: strip(k) != "")
    listed = fields.select(key, F.transform(usable, strip).alias("_kws"))
    return (
        listed.select(key, F.posexplode_outer("_kws").alias("_pos", "keyword"))
        .filter(F.col("_pos").isNotNull())
        .select(key, (F.col("_pos") + 1).alias("kw_ord"), "keyword", (F.col("_pos") < limit).alias("within_limit"))
    )


def ranked_keywords(keywords: DataFrame, key: str, order: str, limit: int = MAX_KEYWORDS) -> DataFrame:
    """All keywords of a table with their rank in a key and ``within_limit``; safe for a hot key."""
    counted = running_total(keywords.withColumn("_one", F.lit(1)), key, order, "_one", "kw_ord").drop("_one")
    return counted.withColumn("within_limit", F.col("kw_ord") <= limit)
