"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from pairloom.plans.catalog import QUERIES
from pairloom.session import local_session, release

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CORES = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "clean_text",
    "stem_titles",
    "prepare_records_stemmed",
    "block_initials_hash",
    "block_full_ngram3",
    "block_year_publisher",
    "block_stats",
    "match_initials_hash",
    "match_full_hash",
    "match_length",
    "baseline_jac_title_70",
    "baseline_jac_70",
    "baseline_exact_70",
    "baseline_edit_title_85",
    "clusters_components",
    "clusters_first_fit",
    "evaluate_blocking",
    "sweep_columns",
    "replication_sweep",
)


def main() -> None:
    spark = local_session(CORES, "bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        release(spark)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "entity_resolution_total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(FOLDER)).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
