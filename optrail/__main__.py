"""python -m optrail LOG OUT [--enabled NAME] [--case NAME] [--activity NAME] [--timestamp NAME] [--separator SEP]: views of a CSV or XES log, with an XES file set for each."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import log as lg
from .operators import views as vw
from .sources import logs


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("log")
    p.add_argument("out")
    p.add_argument("--enabled")
    p.add_argument("--case", default=logs.CASE, help="column of a CSV log that names the case")
    p.add_argument("--activity", default=logs.ACTIVITY)
    p.add_argument("--timestamp", default=logs.TIME)
    p.add_argument("--separator", default=",")
    p.add_argument("--top", type=int, default=20, help="views to export as logs of their own")
    a = p.parse_args()
    spark = SparkSession.builder.appName("optrail").getOrCreate()
    csv = a.log.lower().endswith(".csv")
    events = logs.load_csv(spark, a.log, a.enabled, a.separator, a.case, a.activity, a.timestamp) if csv else logs.load_xes(spark, a.log, a.enabled or "enabled_activities", a.separator)
    traces = lg.traces_of(events).cache()
    variants = lg.variants_of(traces, with_ids=True).cache()
    views = vw.induce_views(variants).cache()
    views.drop("first_ord").write.mode("overwrite").csv(f"{a.out}/views", header=True)
    cases = vw.cases_by_view(vw.assign_views(variants, views))
    for r in views.orderBy(F.desc("n_cases"), "first_ord").limit(a.top).select("label", "kappa", "n_cases").collect():
        print(r.label, r.n_cases, r.kappa)
        logs.export_xes(traces.join(cases.where(F.col("label") == r.label).select("case_id"), "case_id", "left_semi"), f"{a.out}/{r.label}")


if __name__ == "__main__":
    main()
