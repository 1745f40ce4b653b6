"""Batch jobs over stored care tables: load, compute, write.

``python -m tendril run <job> --tables <path> --out <path> [--as-of TS]``
(or ``spark-submit``) loads the tables written by ``write_tables`` /
``load_tables``, runs one view / function / rule / quality job for every key
and writes the result as parquet.  Nothing is collected to the driver.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tendril.plans import analytics as A
from tendril.plans import quality as Q
from tendril.plans import rules as R
from tendril.plans import temporal as TM
from tendril.plans import views as V
from tendril.sources.tables import CareTables, load_tables


def _history(t: CareTables) -> DataFrame:
    if t.plants_history is None:
        raise ValueError("this job needs the plants_history table")
    return t.plants_history


JOBS: dict[str, Callable[[CareTables, str], DataFrame]] = {
    "plants_overview": V.plants_overview,
    "events_detailed": V.events_detailed,
    "plant_type_stats": V.plant_type_stats,
    "growth_timeline": lambda t, now: V.growth_timeline(t),
    "active_reminders": V.active_reminders,
    "calendar": lambda t, now: V.calendar(t),
    "measurements_overview": V.measurements_overview,
    "growth_statistics": V.growth_statistics,
    "health_alerts": V.health_alerts,
    "active_plants": A.active_plants,
    "growth_stats": lambda t, now: A.growth_stats(t),
    "needs_attention": A.needs_attention,
    "upcoming_reminders": A.upcoming_reminders,
    "measurement_trend": A.measurement_trend,
    "health_analysis": A.health_analysis,
    "plant_card_flags": A.plant_card_flags,
    "height_trends": A.height_trends,
    "latest_measurement": lambda t, now: A.latest_measurement(t),
    "dashboard_metrics": A.dashboard_metrics,
    "reminder_board": A.reminder_board,
    "reminder_status_counts": A.reminder_status_counts,
    "plant_age_labels": A.plant_age_labels,
    "plant_at_time": lambda t, now: TM.point_in_time(t.plants, _history(t), now),
    "history_summary": lambda t, now: TM.history_summary(_history(t)),
    "event_reminders": lambda t, now: R.event_reminders(t.events, t, now),
    "health_warnings": lambda t, now: R.health_warnings(t.measurements, t, now),
    "dq_violations": lambda t, now: Q.care_table_violations(t),
}


def run(spark: SparkSession, job: str, tables: str, out: str, as_of: str | None, mode: str = "overwrite") -> None:
    t = load_tables(spark, tables)
    JOBS[job](t, as_of).write.mode(mode).parquet(out)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tendril")
    sub = p.add_subparsers(dest="cmd", required=True)
    r = sub.add_parser("run", help="run one job over stored care tables")
    r.add_argument("job", choices=sorted(JOBS))
    r.add_argument("--tables", required=True)
    r.add_argument("--out", required=True)
    r.add_argument("--as-of", default=None, help="'yyyy-MM-dd HH:mm:ss' (timestamp without zone); default: now")
    sub.add_parser("list", help="list the jobs")
    a = p.parse_args(argv)
    if a.cmd == "list":
        print("\n".join(sorted(JOBS)))
        return
    spark = SparkSession.builder.appName(f"tendril-{a.job}").getOrCreate()
    from tendril.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    run(spark, a.job, a.tables, a.out, a.as_of)
