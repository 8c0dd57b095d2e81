"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text is cut at positions that depend only on nearby characters. Every chunk
travels once, to be grouped by its bytes; from then on a document is the
ordered list of its chunks' identifiers, and only those short lists are
compared. An identifier is the chunk's 64-bit hash, which the grouping by
bytes verifies: where two different chunks share a hash, their rank within the
hash becomes part of the identifier.

Defined cases: null text counts as empty; empty texts form a group of their
own; a null doc_id takes part but is never kept unless its whole group has none;
repeated rows with one doc_id share that group's decision; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, text_or_empty, written

#: A boundary follows four characters of this class and a space. It decides only how texts are cut.
ANCHOR = "[acegikmoqsuwyACEGIKMOQSUWY13579]"


def chunk_pattern(least: int = 256, most: int = 2048) -> str:
    return rf"(?s).{{{least},{most}}}?(?<={ANCHOR}{{4}} )|.{{1,{most}}}"


def exact_duplicates(docs: DataFrame, least: int = 256, most: int = 2048) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row."""
    normal = F.regexp_replace(text_or_empty(), SPACE, " ")
    cut = docs.select("doc_id", normal.alias("t")).select(
        "doc_id", F.sha2("t", 256).alias("text_sha256"), F.regexp_extract_all("t", F.lit(chunk_pattern(least, most)), F.lit(0)).alias("chunks")
    )
    recipes = written(
        cut.select("doc_id", "text_sha256", F.transform("chunks", lambda c: F.xxhash64(c)).alias("recipe")), "recipes"
    )
    chunks = cut.select(F.explode("chunks").alias("chunk")).select(F.xxhash64("chunk").alias("h"), "chunk")
    verified = chunks.groupBy("h", "chunk").agg(F.lit(1).alias("one"))
    clashing = written(verified.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "clashes")
    none = F.expr("cast(array() as array<bigint>)")
    if clashing.isEmpty():
        named = recipes.withColumn("ranks", none)
    else:
        where = cut.select("doc_id", "text_sha256", F.posexplode("chunks").alias("pos", "chunk")).withColumn("h", F.xxhash64("chunk"))
        where = where.join(clashing.select("h"), "h", "left_semi")
        texts = where.select("h", "chunk").distinct()
        rank = texts.alias("x").join(texts.alias("y"), (F.col("x.h") == F.col("y.h")) & (F.col("y.chunk") <= F.col("x.chunk")))
        rank = rank.groupBy(F.col("x.h").alias("h"), F.col("x.chunk").alias("chunk")).agg(F.count("*").cast("int").alias("rank"))
        ranks = where.join(rank, ["h", "chunk"]).groupBy("text_sha256").agg(
            F.sort_array(F.collect_set(F.struct("pos", "rank"))).alias("r")
        )
        ranks = ranks.select("text_sha256", F.transform("r", lambda x: x["pos"].cast("long") * (1 << 20) + x["rank"]).alias("ranks"))
        named = recipes.join(ranks, "text_sha256", "left").withColumn("ranks", F.coalesce("ranks", none))
    key = ["recipe", "ranks"]
    groups = named.groupBy(*key).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return named.join(groups, key).select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256"
    )
