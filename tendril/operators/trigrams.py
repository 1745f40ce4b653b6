"""Search of many needles in many texts by an inverted index of trigrams.

The index has a row per text and distinct run of three characters in it, and runs
of two, of one and of none for needles (or pieces of them) that are shorter.  A
needle is looked up by the rarest of its longest runs; the texts found so are
compared with LIKE.  ``%`` and ``_`` in a needle are wildcards, as in the lists'
search fields.  Needles meet texts by equi-joins only.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendril.session import checkpoint_path

LONGEST = 3
#: Characters of text that one task of the index cuts into runs and sorts (about).
PART_CHARS = 1_000_000


@dataclass
class TrigramIndex:
    postings: DataFrame  # gram, id
    counts: DataFrame  # gram, n


def _runs(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters of a text."""
    if size == 0:
        return F.array(F.lit(""))
    last = F.char_length(text) - size
    # the text is split once, not once for each of its runs
    run = lambda chars: lambda i: F.concat(*[F.get(chars, i + k) for k in range(size)])
    runs = lambda chars: F.transform(F.sequence(F.lit(0), last), run(chars))
    return F.when(last >= 0, F.array_distinct(F.transform(F.array(F.split(text, "")), runs)[0])).otherwise(
        F.array().cast("array<string>")
    )


def build_index(texts: DataFrame, id_col: str, text_col: str) -> TrigramIndex:
    """The index of ``texts``, stored; each part covers some of the texts, its rows sorted by
    gram, so a gram that is in every text is spread over all parts.  NULL texts are not in it.

    Only the texts are shuffled: they are dealt out before they are cut, as a few small
    files of texts become many runs."""
    spark = texts.sparkSession
    base = checkpoint_path(spark, f"trigrams-{uuid.uuid4().hex}")
    t = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    chars = t.agg(F.coalesce(F.sum(F.char_length("_text") + 1), F.lit(0)).alias("n")).first()["n"]
    grams = F.concat(*[_runs(F.col("_text"), n) for n in range(LONGEST + 1)])
    rows = t.repartition(max(1, math.ceil(chars / PART_CHARS))).select(F.explode(grams).alias("gram"), "id")
    rows.sortWithinPartitions("gram", "id").write.parquet(f"{base}/postings")
    postings = spark.read.parquet(f"{base}/postings")
    postings.groupBy("gram").agg(F.count("*").alias("n")).write.parquet(f"{base}/counts")
    return TrigramIndex(postings, spark.read.parquet(f"{base}/counts"))


def search(index: TrigramIndex, texts: DataFrame, id_col: str, text_col: str, needles: DataFrame) -> DataFrame:
    """``needle, id`` of every text that contains the needle (``LIKE '%needle%'``), for the
    distinct, not NULL needles of ``needles(needle)``; an empty needle is in every text."""
    n = needles.select(F.col("needle").cast("string").alias("needle")).where("needle IS NOT NULL").distinct()
    pieces = F.split(F.col("needle"), "[%_]")
    longest = F.least(F.array_max(F.transform(pieces, F.char_length)), F.lit(LONGEST))
    of_size = lambda k: F.flatten(F.transform(pieces, lambda p: _runs(p, k)))
    grams = of_size(0)
    for k in range(1, LONGEST + 1):
        grams = F.when(longest == k, of_size(k)).otherwise(grams)
    asked = n.select("needle", F.explode(F.array_distinct(grams)).alias("gram"))
    known = asked.join(index.counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = known.groupBy("needle").agg(F.min(F.struct("n", "gram")).alias("x")).where("x.n > 0")
    # stored, so that its size is known before the postings are read: few needles go to the
    # postings, which then stay in place
    at = checkpoint_path(texts.sparkSession, f"needles-{uuid.uuid4().hex}")
    rarest.select("needle", F.col("x.gram").alias("gram")).write.parquet(at)
    found = texts.sparkSession.read.schema("needle string, gram string").parquet(at).join(index.postings, "gram").select("needle", "id")
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    pattern = F.concat(F.lit("%"), F.replace(F.col("needle"), F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    return found.join(rows, "id").where(F.like(F.col("_text"), pattern)).select("needle", "id")
