"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1) and BENCH_CPUS the local cores (default 8).
"""

from __future__ import annotations

import json
import os
import time

from windspan.plans.table_queries import QUERIES
from windspan.session import local_session

HEADLINE = (
    "site_features",
    "site_grid_join",
    "series_max",
    "target_join",
    "capacity",
    "interpolate",
    "interpolate_minutes",
    "smooth_5",
    "fold_id",
    "weighted_mae",
    "mirror_copy",
    "tree_series",
    "stream_ingest",
    "regular_rows",
    "search_scores",
    "forest_search",
    "dual_model",
    "site_forecast",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("OFF")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    # One untimed pass compiles the plans, as in a session that serves more than one query.
    for name in HEADLINE:
        run(name)
    seconds = {name: round(run(name), 3) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline query wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
