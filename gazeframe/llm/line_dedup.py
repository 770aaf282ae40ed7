"""Lines that many documents share, kept in one of them.

Texts are exploded into lines; a line's key is two 64-bit hashes of its normal form. Keys are counted in two
steps, first per document and then per key, so that a line in every document is combined before the
shuffle of its key. Only the keys over the threshold meet the narrow occurrences again; what a document loses
comes back as positions, and the text is put together from all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazeframe.session import scratch_path

LEAST_CHARS = 20
LEAST_DOCUMENTS = 3

_WHITE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case; no other letter changes."""
    bare = F.btrim(line, F.lit(_WHITE))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _own(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and ``tag``, which tells texts of one id apart."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tag"))


def shared_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """``doc_id, tag, dropped``: the positions that each text loses; texts that lose none have no row."""
    spark = docs.sparkSession
    lined = _own(docs).select("doc_id", "tag", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    keyed = lined.select("doc_id", "tag", "pos", line_key(F.col("line")).alias("line")).where(F.length("line") >= least_chars)
    # Rows of one id are one document; those without an id are told apart by their text and come last.
    lone = F.when(F.col("doc_id").isNull(), F.col("tag")).otherwise(F.lit(0))
    hashed = keyed.select(
        F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), "doc_id", lone.alias("lone"), "tag", "pos"
    )
    path = scratch_path(spark, "line-places")
    hashed.groupBy("h", "g", "doc_id", "lone", "tag").agg(F.collect_set("pos").alias("at")).write.parquet(path)
    places = spark.read.parquet(path)
    document = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "lone")
    frequent = (
        places.groupBy("h", "g", "doc_id", "lone").agg(F.lit(1).alias("one"))
        .groupBy("h", "g").agg(F.sum("one").alias("n"), F.max(document).alias("last"))
        .where(F.col("n") >= least_documents)
    )
    # A frequent key's places are one side of this join and its single row the other: adaptive execution splits them.
    lost = places.join(frequent, ["h", "g"]).where(document != F.col("last"))
    return lost.groupBy("doc_id", "tag").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("dropped"))


def drop_shared_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped`` for every row of ``docs`` (``doc_id``, ``text``), ``text`` without its shared lines.

    Lines end at \\n only. A line whose key has ``least_chars`` code points or more and stands in
    ``least_documents`` documents or more stays only in the one with the largest id, as often as it is there. A null or empty text is one
    empty line and stays an empty text. Rows of one id are one document: they count once and keep or lose a key
    together. Rows without an id are a document for each different text, all after the numbered ones. Repeated rows get the same
    answer each. Other columns are ignored; an empty table gives an empty result.
    """
    lost = shared_lines(docs, least_chars, least_documents).select(
        F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "dropped"
    )
    own = _own(docs)
    joined = own.join(lost, own["doc_id"].eqNullSafe(F.col("_id")) & (own["tag"] == F.col("_tag")), "left")
    lines = _lines(F.col("text"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    rest = F.array_join(F.transform(kept, lambda i: F.element_at(F.col("lines"), i + 1)), "\n")
    cut = joined.withColumn("lines", F.when(F.col("dropped").isNotNull(), lines))
    return cut.select(
        "doc_id",
        F.coalesce(rest, F.col("text")).alias("text"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
