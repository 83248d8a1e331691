"""Headline queries, timed one by one. Prints one JSON line.

The large tables come as files of one row group each, which one task reads whatever the cores. They are written again as a
file per core before the clock starts, so that the seconds are those of the queries. Tasks are reported beside them.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
from pathlib import Path

from shopledger.registry.queries import queries
from shopledger.session import local_session

HEADLINE = (
    "revenue_by_month",
    "total_revenue_new",
    "aov_over_time",
    "new_vs_returning_sales",
    "retention_rate",
    "customers_by_location",
    "sales_by_product",
    "customer_lifetime_value",
    "cac_ltv_by_month",
    "pl_statement_long",
    "product_profitability",
    "fee_breakdown",
    "margin_breakdown",
    "bank_account_summary",
    "browse_bank_transactions",
    "clean_statement",
    "clean_bank_transactions",
    "dim_customer",
    "fact_bank",
    "upsert_dimension",
)


#: Tables that are written again with a file per core.
LARGE = ("lineitem", "orders")


def spread(spark, sf_dir: str, files: int) -> str:
    """A folder with the same tables, the large ones in ``files`` files; the others are links."""
    folder = tempfile.mkdtemp(prefix="bench-")
    for path in Path(sf_dir).glob("*.parquet"):
        target = Path(folder) / path.name
        if path.stem in LARGE:
            spark.read.parquet(str(path)).repartition(files).write.parquet(str(target))
        else:
            target.symlink_to(path)
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "shopledger-bench", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    known = queries()
    given, sf_dir = sf_dir, spread(spark, sf_dir, spark.sparkContext.defaultParallelism)
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()  # start the executors
    seconds, tasks = {}, {}
    tracker = spark.sparkContext.statusTracker()
    for name in HEADLINE:
        spark.sparkContext.setJobGroup(name, name)
        start = time.perf_counter()
        # every row and column is computed; nothing is collected
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        stages = {s for job in tracker.getJobIdsForGroup(name) if (info := tracker.getJobInfo(job)) for s in info.stageIds}
        tasks[name] = sum(found.numTasks for s in stages if (found := tracker.getStageInfo(s)))
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(given).removeprefix("sf"), "tasks": tasks}))


if __name__ == "__main__":
    main()
