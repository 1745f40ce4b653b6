"""Stabbing join: points of time and all intervals of their key that hold them.

``asof_join`` finds the one version that began last; histories may overlap, so that
an instant lies in several intervals, and all are wanted.  An equi-join on the key
with a range filter forms every pair of a key: at most ``DENSE`` per interval where a
key has so few points, which costs less than copies of the interval.  For keys of more
points time is cut into months, and every ``LONG`` months make a long block.  An interval is filed under the long
blocks that it covers and, at its ends, under single months; a point is looked up
under its month and its long block.  Both lie in one place for every hit, so each
is reported once, and a pair is only formed where the two share a month or a block
that the interval covers.  Open intervals are cut at the last point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendril.session import ensure_checkpoint_dir

#: Months of a long block.
LONG = 24
#: Points of a key beyond which its time is cut.
DENSE = 256
#: Parts of a crowded key's rows when they are told from others.
PARTS = 8


def _month(t: Column) -> Column:
    return F.year(t) * 12 + F.month(t) - 1


def _cells(start: Column, end: Column) -> Column:
    """The (length, number) cells of all months from ``start`` to ``end``, both included:
    whole long blocks, and months before and after them."""
    first, stop = F.ceil(start / LONG), F.floor((end + 1) / LONG)  # whole blocks first .. stop - 1
    cell = lambda n: lambda x: F.struct(F.lit(n).alias("months"), x.cast("int").alias("number"))
    run = lambda a, b: F.when(a < b, F.sequence(a.cast("int"), (b - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    whole = first < stop
    return F.concat(
        F.transform(run(first, stop), cell(LONG)),
        F.transform(run(start, F.when(whole, first * LONG).otherwise(end + 1)), cell(1)),
        F.transform(F.when(whole, run(stop * LONG, end + 1)).otherwise(F.array().cast("array<int>")), cell(1)),
    )


def stabbing_join(
    points: DataFrame, intervals: DataFrame, key: str, at: str, start: str = "valid_from", end: str = "valid_to",
    prefix: str = "v_", dense: int = DENSE,
) -> DataFrame:
    """Every row of ``points`` with every row of ``intervals`` of the same ``key`` and
    ``start <= at < end``; the intervals' other columns get ``prefix``.

    A point without a hit gives no row.  NULL keys, points and ends hit nothing, empty
    intervals (``start >= end``) neither; repeated rows on either side count each.
    At most ``dense`` pairs are formed per interval of a key of so few points.  Keys of more
    points (stored, less than a ``dense``-th of the points) are cut by month: their work is
    that of the hits, plus pairs of one month at an interval's ends, and as both sides are
    shuffled then, AQE splits a month that is still too large."""
    least, last = points.agg(F.min(at).alias("least"), F.max(at).alias("last")).first()
    p = points.where(F.col(at).isNotNull() & F.col(key).isNotNull())
    v = intervals.where(F.col(key).isNotNull() & (F.col(start) < F.col(end)))
    if last is None:
        v = v.limit(0)
    else:
        v = v.where((F.col(start) <= F.lit(last)) & (F.col(end) > F.lit(least)))
    others = [c for c in intervals.columns if c not in (key, start, end)]
    v = v.select(F.col(key).alias("_key"), *[F.col(c).alias(prefix + c) for c in [start, end, *others]])
    hit = F.col(key) == F.col("_key")
    inside = (F.col(prefix + start) <= F.col(at)) & (F.col(prefix + end) > F.col(at))
    counts = p.groupBy(F.col(key).alias("_of")).agg(F.count("*").alias("_n")).where(F.col("_n") > dense)
    ensure_checkpoint_dir(points.sparkSession)
    many = counts.select("_of", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_part")).checkpoint(eager=True)
    if many.isEmpty():
        return p.join(v, hit & inside).drop("_key")
    cell = lambda months, number: F.struct(F.lit(months).alias("months"), number.cast("int").alias("number"))

    def marked(rows: DataFrame, of: str, t: str, cells: Column, name: str) -> DataFrame:
        """Rows once for each of their cells; all rows of a key that is not in ``many`` share one."""
        part = F.pmod(F.xxhash64(t), F.lit(PARTS)) == F.col("_part")
        told = rows.join(many, (F.col(of) == F.col("_of")) & part, "left")
        here = F.when(F.col("_of").isNull(), F.array(cell(0, F.lit(0)))).otherwise(cells)
        return told.withColumn(name, F.explode(here)).drop("_of", "_part")

    month = _month(F.col(at))
    covered = _cells(
        F.greatest(_month(F.col(prefix + start)), _month(F.lit(least))),
        F.least(_month(F.col(prefix + end)), _month(F.lit(last))),
    )
    p = marked(p, key, at, F.array(cell(1, month), cell(LONG, F.floor(month / LONG))), "_at")
    v = marked(v, "_key", prefix + start, covered, "_cell")
    return p.join(v, hit & (F.col("_at") == F.col("_cell")) & inside).drop("_key", "_at", "_cell")
