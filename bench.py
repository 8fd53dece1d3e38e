"""Times the headline queries, then operators over a wide generated cube, on one machine; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

from stratoframe.operators import series, statistics
from stratoframe.plans import catalogue
from stratoframe.plans.dataset import open_dataset, scan
from stratoframe.plans.synthetic import points
from stratoframe.session import local_session

HEADLINE = (
    "scan_cube_wide", "subset_start_end", "statistics", "statistics_tendencies", "join_variables", "merge_interleaved", "fill_missing_interpolate", "interpolate_frequency", "rolling_average",
    "complement_nearest_k3", "window_tumbling", "window_sliding", "window_single_sample", "tabular_sort_dedup", "tabular_index_runs", "griddify_nearest", "traj_envelope", "traj_tendencies", "accumulate_from_zero", "recentre_members",
)


def read_whole(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def wide(spark: SparkSession, folder: str, cells: int = 100_000) -> dict[str, float]:
    """Seconds of operators over 40 dates, three variables and so many cells, read from Parquet."""
    spec = {"start": "2021-01-01", "end": "2021-01-10T18:00:00", "frequency": "6h", "geography": cells, "variables": ["a", "b", "c"]}
    made = open_dataset(spark, synthetic=spec)
    made.rows().write.parquet(f"{folder}/rows")
    made.grid.write.parquet(f"{folder}/grid")
    cube = scan(spark.read.parquet(f"{folder}/rows"), made.frequency, spark.read.parquet(f"{folder}/grid"))
    plans = {
        "statistics": lambda: statistics.statistics(cube), "tendency_statistics": lambda: statistics.tendency_statistics(cube, ["6h", "24h"]), "rolling_average": lambda: series.rolling_average(cube, -1, 1).rows(),
        "interpolate_frequency": lambda: series.interpolate_frequency(cube, "3h").rows(), "thin_grid": lambda: cube.thin(200.0, "grid").rows(), "nearest_k3": lambda: series.nearest(cube.grid, points(spark, cells // 5)[0], 3),
    }
    took = {}
    for name, plan in plans.items():
        began = time.perf_counter()
        read_whole(plan())
        took[name] = round(time.perf_counter() - began, 3)
    return took


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.queries()
    run = lambda name: read_whole(queries[name](spark, folder))
    run("statistics")
    run("window_tumbling")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(2):
            began = time.perf_counter()
            run(name)
            times.append(time.perf_counter() - began)
        took[name] = round(min(times), 3)
    with tempfile.TemporaryDirectory() as scratch:
        cells = wide(spark, scratch)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "wide": cells, "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
