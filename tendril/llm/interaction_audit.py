"""How five document filters interact, over all 120 orders of applying them.

A document is told by its mask: which filters it fails, whether it is good and
whether it is toxic.  What happens to it at every step of every order depends on
the mask alone, so each mask maps to one wide packed counter: a big integer of
``FIELDS`` 64-bit fields, one per outcome and (order, step).  Documents are first
counted by part and mask, 128 counts a part at most; a part's counters are then
the sum of its masks' integers times their counts, and are unpacked from its
bytes.  No field can run over: it holds at most the number of documents.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendril.llm.common import spread_join, text_udf

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
SYMBOLS = b"#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
ORDERS = list(permutations(range(len(FILTERS))))
STEPS = [(o, s) for o in ORDERS for s in range(len(FILTERS))]
FIELDS = len(OUTCOMES) * len(STEPS)
#: Per (order, step) the filter applied there, and the bits of those applied before.
AT = np.array([o[s] for o, s in STEPS])
BEFORE = np.array([sum(1 << f for f in o[:s]) for o, s in STEPS])
GOOD, TOXIC = 1 << len(FILTERS), 2 << len(FILTERS)
RESULT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def text_mask(text: str) -> int:
    """Bits of the filters A to D that a text fails."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    few = len(words) < LEAST_WORDS
    dull = 100 * len(set(words)) < DISTINCT_PERCENT * len(words)
    loud = 100 * (len(raw) - len(raw.translate(None, CAPITALS))) > CAPITAL_PERCENT * len(text)
    odd = len(raw.translate(None, SYMBOLS)) < len(raw)
    return few | dull << 1 | loud << 2 | odd << 3


def outcomes(mask: int) -> np.ndarray:
    """0 or 1 per outcome and (order, step) for a document of this mask."""
    fails, gone = mask >> AT & 1 == 1, mask & BEFORE != 0
    removed = fails & ~gone
    alone = fails & (mask & (GOOD - 1) == 1 << AT)
    good, toxic = removed & bool(mask & GOOD), removed & bool(mask & TOXIC)
    return np.stack([~gone & ~fails, removed, fails & gone, alone, good, toxic]).astype(np.uint64)


def packed(mask: int) -> int:
    """The outcomes of a mask as one integer of 64-bit fields."""
    return int.from_bytes(outcomes(mask).astype("<u8").tobytes(), "little")


def unpacked(total: int) -> np.ndarray:
    """Counts per outcome and (order, step) of a sum of packed masks."""
    fields = np.frombuffer(total.to_bytes(8 * FIELDS, "little"), "<u8")
    return fields.reshape(len(OUTCOMES), len(STEPS)).astype(np.int64)


def _audit_part(rows: pd.DataFrame) -> pd.DataFrame:
    """The 600 rows of one part from its counts by mask (128 rows at most)."""
    total = sum(packed(int(m)) * int(n) for m, n in zip(rows["mask"], rows["n"]))
    counts = dict(zip(OUTCOMES, unpacked(total)))
    shapley = np.array([counts["removed"][AT == f].sum() for f in range(len(FILTERS))])
    return pd.DataFrame(
        {
            "part": rows["part"].iloc[0],
            "filter_order": ["".join(FILTERS[f] for f in o) for o, _ in STEPS],
            "step": np.array([s + 1 for _, s in STEPS], np.int32),
            **counts,
            "shapley": shapley[AT],
        }
    )


def _labels(labels: DataFrame) -> DataFrame:
    """One row per labelled id; of several labels the larger one counts."""
    marked = labels.where(F.col("doc_id").isNotNull()).select("doc_id", "quality", "toxic")
    return marked.groupBy("doc_id").agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"),
    )


def _with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows(doc_id, ...)`` with ``bits`` of their labels; a hot id's rows stay spread."""
    ids = rows.where(F.col("doc_id").isNotNull())
    per_id = ids.groupBy("doc_id").agg(F.count("*").alias("rows_of_id"))
    facts = per_id.join(_labels(labels), "doc_id", "left").select(
        "doc_id",
        (F.coalesce("good", F.lit(0)) * GOOD + F.coalesce("toxic", F.lit(0)) * TOXIC).alias("bits"),
        "rows_of_id",
    )
    total = per_id.agg(F.sum("rows_of_id")).first()[0] or 0
    named = spread_join(ids, facts, "doc_id", "rows_of_id", total)
    return named.unionByName(rows.where(F.col("doc_id").isNull()).withColumn("bits", F.lit(0)))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n``: documents by part, failed filters and labels.

    Filter E needs the smallest id of every text: texts are compared by their
    SHA-256.  Copies are counted by (text, part, labels) before they meet, so a
    text with very many copies is a few rows there."""
    rows = docs.select(
        "doc_id",
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        text_udf("int", lambda: text_mask)(F.col("text")).alias("mask"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"),
    )
    rows = rows.groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    rows = _with_labels(rows, labels).withColumn("mask", F.col("mask") + F.col("bits"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    texts = rows.groupBy("digest", "part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"), first.alias("first")
    )
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    texts = texts.withColumn("passes", F.col("no_id") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0))
    either = F.array(
        F.struct(F.col("mask"), F.col("passes").alias("n")),
        F.struct((F.col("mask") + (1 << FILTERS.index("E"))).alias("mask"), (F.col("n") - F.col("passes")).alias("n")),
    )
    told = texts.select("part", F.explode(either).alias("x")).select("part", "x.*")
    return told.where("n > 0").groupBy("part", "mask").agg(F.sum("n").alias("n"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    ``docs(doc_id, text, source)``: a null text is empty, a null source is the part
    '' (as is an empty one).  A null id never fails E, is never the smaller id and
    has no labels; repeated rows count each, and those of the smallest id of a text
    all pass E.  Of repeated labels the larger one counts; other columns are
    ignored; an empty table gives no rows."""
    return mask_counts(docs, labels).groupBy("part").applyInPandas(_audit_part, RESULT)


def oracle() -> str:
    """DuckDB SQL of ``audit``."""
    letters = ", ".join(f"('{c}', {i})" for i, c in enumerate(FILTERS))
    return f"""
WITH base AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents),
first_ids AS (SELECT text, min(doc_id) AS least FROM base GROUP BY text),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
                 max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT b.part,
         (len(words) < {LEAST_WORDS})::INT
         + 2 * (100 * len(list_distinct(words)) < {DISTINCT_PERCENT} * len(words))::INT
         + 4 * (100 * length(regexp_replace(b.text, '[^A-Z]', '', 'g')) > {CAPITAL_PERCENT} * length(b.text))::INT
         + 8 * regexp_matches(b.text, '[#$%&*|]')::INT
         + 16 * coalesce(b.doc_id > f.least, false)::INT AS mask,
         coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic, count(*) AS n
  FROM base b JOIN first_ids f ON b.text = f.text LEFT JOIN marks m ON b.doc_id = m.doc_id
  GROUP BY ALL),
letters(c, i) AS (VALUES {letters}),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (
  SELECT filter_order, s::INT AS step, bits[s] AS bit,
         list_sum([0] || [1 << b FOR b IN bits[1:s - 1]]) AS before
  FROM orders, range(1, 6) t(s)),
told AS (
  SELECT part, filter_order, step, bit, n, good, toxic,
         (mask >> bit) & 1 = 1 AS fails, mask & before::INT <> 0 AS gone, mask = 1 << bit AS alone
  FROM masks, steps),
counts AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN fails AND NOT gone AND good = 1 THEN n ELSE 0 END) AS good_lost,
         sum(CASE WHEN fails AND NOT gone AND toxic = 1 THEN n ELSE 0 END) AS toxic_lost
  FROM told GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counts
"""
