"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tendril.session import ensure_checkpoint_dir

#: Words of the contracts: runs without ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Most keys that ``spread_join`` broadcasts.
HOT_KEYS = 20_000
#: Most rows that ``bounded_join`` broadcasts.
BROADCAST_ROWS = 10_000
#: Rows that a Python task hands back at once: what it holds beside its input stays small.
YIELD = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has (case ignored)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def text_udf(return_type: str, make: Callable[[], Callable[[str], object]]):
    """A pandas UDF over one text column; null texts count as empty.

    ``make`` runs once per task and returns the function of one text (tables,
    automata and caches live in its closure).  A struct result is given as a
    tuple in field order."""
    fields = None
    if return_type.startswith("struct<"):
        from pyspark.sql.types import _parse_datatype_string

        fields = _parse_datatype_string(return_type).names

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = make()
        for texts in batches:
            for at in range(0, len(texts), YIELD):
                some = texts.iloc[at : at + YIELD]
                values = [one("" if t is None else t) for t in some]
                yield pd.DataFrame(values, columns=fields) if fields else pd.Series(values, index=some.index)

    run.__annotations__ = {
        "batches": Iterator[pd.Series],
        "return": Iterator[pd.DataFrame] if fields else Iterator[pd.Series],
    }
    return F.pandas_udf(run, return_type)


def cut(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut: stored once in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread_join(rows: DataFrame, facts: DataFrame, on: str, n: str, total: int) -> DataFrame:
    """Inner join of ``rows`` to ``facts``, which has one row per key ``on``, no nulls,
    and in ``n`` how many of the ``total`` rows have the key; ``n`` is dropped.

    A shuffled join would give a hot key's rows to one task (AQE leaves them
    there where ``facts`` is already partitioned by the key).  Keys of more than
    ``total / HOT_KEYS`` rows are ``HOT_KEYS`` at most, so their facts are broadcast
    and their rows stay where they are; only the others are shuffled."""
    many = total // HOT_KEYS
    hot, others = facts.where(F.col(n) > many).drop(n), facts.where(F.col(n) <= many).drop(n)
    got = [c for c in others.columns if c != on]
    marked = rows.join(F.broadcast(hot), on, "left")
    shuffled = marked.where(F.col(got[0]).isNull()).select(rows.columns).join(others, on)
    return marked.where(F.col(got[0]).isNotNull()).unionByName(shuffled)


def bounded_join(rows: DataFrame, facts: DataFrame, on: str, n: str, total: int) -> DataFrame:
    """``spread_join``, or a broadcast of all of ``facts`` where they have ``BROADCAST_ROWS`` rows at most."""
    if facts.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return spread_join(rows, facts, on, n, total)
    return rows.join(F.broadcast(facts.drop(n)), on)


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` of an array of spans, joined by commas in its order."""
    one = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    return F.concat_ws(",", F.transform(spans, one))
