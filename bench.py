"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from marlstone import catalog

NAMES = ["log_returns", "simple_returns", "realized_measures", "rolling_stats", "event_study", "ols_simple", "ols_white", "ols_newey_west", "batched_ols", "rolling_ols", "fixed_effects",
         "fama_macbeth", "har_features", "volatility_garch", "descriptive_stats", "ljung_box", "var_historical", "performance_metrics", "pca", "garch_likelihood"]


COPIES = 20


def _large(spark: SparkSession, sf: str) -> float:
    """Seconds for returns and realised measures of COPIES times as many series: what throughput is once overhead is paid."""
    from pyspark.sql import functions as F

    from marlstone.operators import realized
    from marlstone.sources.tables import read_table

    one = read_table(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    many = one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES)))).withColumn("user_id", F.col("user_id") * F.lit(COPIES) + F.col("copy"))
    t = time.time()
    realized.measures_of_prices(many, "value", ["user_id"], ["ts", "event_id"]).write.format("noop").mode("overwrite").save()
    return time.time() - t


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    queries[NAMES[0]](spark, sf).write.format("noop").mode("overwrite").save()  # warm-up: the JVM and the page cache
    took = {}
    for name in NAMES:
        t = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t, 3)
    took[f"realized_measures_x{COPIES}"] = round(_large(spark, sf), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
