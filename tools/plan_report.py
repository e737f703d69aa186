"""Plan shape of every registered query (sf0.001): parquet scans, exchanges, broadcasts,
whole-stage-codegen stages and Python evaluation nodes.  Writes PLANS.md."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from churnspark.plans.session import local_session  # noqa: E402
from churnspark.registry import QUERIES  # noqa: E402
from churnspark.sources import views  # noqa: E402

MODEL = {"train_logistic", "train_random_forest", "train_boosted_trees", "select_best_model", "score_churn",
         "batch_customer_scoring", "feature_importance", "save_load_model", "feature_columns", "scoring_agreement", "train_enhanced",
         "logistic_coefficients", "boosted_first_splits"}


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = local_session()
    views.analysis(spark, sf)
    rows = []
    for name, fn in sorted(QUERIES.items()):
        if name in MODEL:
            continue
        sc = spark.sparkContext
        sc.setJobGroup(name, name)
        df = fn(spark, sf)
        df.collect()  # runs this QueryExecution, so executedPlan below is the final adaptive plan (sf0.001: tiny)
        jobs = len(sc.statusTracker().getJobIdsForGroup(name))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in plan or "AdaptiveSparkPlan" not in plan, name
        final = plan.split("== Initial Plan ==")[0]  # the text holds the plan before adaption as well
        rows.append((name, final.count("Scan parquet") + final.count("Scan csv"), final.count("Exchange ")
                     - final.count("BroadcastExchange") - final.count("ReusedExchange"),
                     final.count("BroadcastExchange"), final.count("*("),
                     final.count("SinglePartition"),
                     final.count("BatchEvalPython") + final.count("ArrowEvalPython") + final.count("MapInArrow"), jobs))
    out = ["# Plan shapes (sf0.001, generated by tools/plan_report.py)", "",
           "Counts in the final adaptive plan of each registered query (model fits excluded); the initial plan in the "
           "same text is cut off. Scans read the written analysis table, written orderings, or small statistics files. "
           "`single` counts exchanges to one partition: the final step of a global aggregate, whose input is one "
           "partial row per map task, or running offsets of one row per partition. `jobs` counts all Spark jobs of the "
           "query, the eager ones (statistics, range orderings, side tables, size checks) and those of the adaptive "
           "stages. `python` counts Python nodes (always 0).", "",
           "| query | scans | shuffles | broadcasts | codegen stages | single | python | jobs |", "|---|---|---|---|---|---|---|---|"]
    out += [f"| `{n}` | {a} | {b} | {c} | {d} | {e} | {f} | {g} |" for n, a, b, c, d, e, f, g in rows]
    open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w").write(
        "\n".join(out) + "\n")
    print(f"{len(rows)} plans")


if __name__ == "__main__":
    main()
