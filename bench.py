"""Time the headline queries. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Every query is computed from the tables each time: nothing is cached between queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marginloom import registry  # noqa: E402
from marginloom.session import build_session  # noqa: E402

HEADLINE = [
    "synth_individuals", "synth_persons", "synth_households", "population_cells",
    "margin_validation", "distribution", "family_stats", "family_integrity_violations",
    "stage_changes", "hierarchy_margins", "rank_within_group", "select_n_per_cell", "row_diff",
    "equation_check", "reaggregate_exact", "latest_release", "keyset_page_desc_nulls_last",
    "boundary_dissolve_edges", "search_texts", "text_manifest",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", **{
        "spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    registry.load()

    def run(name: str) -> float:
        start = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("family_integrity_violations")  # start the JVM's compilers
    seconds = {name: round(run(name), 3) for name in HEADLINE}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(folder).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
