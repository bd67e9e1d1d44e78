"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.path.dirname(os.path.abspath(__file__)) + os.pathsep + os.environ.get("PYTHONPATH", "")

from pyspark.sql import SparkSession  # noqa: E402

QUERIES = ["broad_all", "broad_grid", "hard_clashes", "hard_flush_lattice", "clearance", "detect_both"]


def box_scene(spark: SparkSession, n: int = 10_000) -> tuple[float, int]:
    """Seconds and clashes of hard detection over n boxes at hashed places, about as many candidates as boxes."""
    from pyspark.sql import functions as F

    from meshjoin.plans.detect import candidates_of, clashes_of
    from meshjoin.plans.scenes import box_elements
    from meshjoin.schema import Rules

    place = lambda k: F.pmod(F.xxhash64("gi", F.lit(k)), F.lit(1_000_000)) / 1e6
    rows = spark.range(n).select(
        F.col("id").alias("gi"), F.col("id").cast("string").alias("element_id"), F.lit("m0").alias("model_id"), F.lit("T0").alias("ifc_type"),
        *[(place(k) * 40).alias(c) for k, c in enumerate(("cx", "cy", "cz"))], (0.2 + 0.5 * place(3)).alias("h"),
    )
    began = time.time()
    elements = box_elements(rows).persist()
    found = clashes_of(candidates_of(elements, Rules()), elements, Rules(), with_point=False).count()
    elements.unpersist()
    return round(time.time() - began, 3), found


def main() -> None:
    from meshjoin.plans import queries as engine

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times, rows = {}, {}
    for name in QUERIES:
        began = time.time()
        rows[name] = engine.QUERIES[name](spark, sf_dir).count()
        times[name] = round(time.time() - began, 3)
    times["detect_10k_boxes"], rows["detect_10k_boxes"] = box_scene(spark)
    boxes = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "rows": rows,
        "elements_per_sec": round(boxes / times["detect_both"], 1), "candidate_pairs_per_sec": round(rows["broad_all"] / times["hard_clashes"], 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
