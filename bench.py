"""Headline queries over the catalog derived from ``$BENCH_SF_DIR`` (default sf0.1).

Every query is run to the end (rows written to a no-op sink) on a warm session; the median of
``$BENCH_RUNS`` runs counts. The incremental run (``layers_5_percent``) is timed alone: one procedure
in twenty has changed since the version it starts from. The kept index is written before it is searched.
Prints one JSON line, with the volume of the texts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

import checks  # noqa: E402
from checks.base import Catalog  # noqa: E402
from threadline import build_session  # noqa: E402
from threadline.operators import text_index  # noqa: E402
from threadline.plans import layers  # noqa: E402
from threadline.session import scratch_dir  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = (
    "D9_build_nodes",
    "C16_run_rules",
    "C25_resolve_ids",
    "C33_parse_definitions",
    "B1_objects_to_parse",
    "B3_snapshot_diff",
    "B6_merge_edges",
    "B_full_refresh_edges",
    "B_incremental_refresh_edges",
    "D7_bidirectional_pairs",
    "E1_trace",
    "E1_trace_all_levels",
    "E3_reachable_from_focus",
    "F4_unified_ddl",
    "F5_postings_documents",
    "F6_search_documents",
    "G4_all_metrics",
    "G6_gap_stats",
)


def _incremental(catalog: Catalog):
    """A run over 5 % changed procedures; its first version is written here."""
    changed = (F.col("object_type") == "Stored Procedure") & (F.floor(F.col("object_id") / 10) % 20 == 1)
    date = F.when(changed, F.col("modify_date") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("modify_date"))
    now = {"objects": catalog.objects, "definitions": catalog.definitions, "dependencies": catalog.dependencies}
    root = scratch_dir(catalog.spark, "bench-layers")
    layers.advance({**now, "objects": catalog.objects.withColumn("modify_date", date)}, root, number=0)
    return lambda: layers.advance(now, root, number=1)


def _kept_search(catalog: Catalog):
    index = text_index.create(catalog.documents, scratch_dir(catalog.spark, "bench-index"), "doc_id", ["text"])
    return lambda: text_index.search(catalog.spark, index, "ention, the THAN").hits.collect()


def _median(run) -> float:
    runs = []
    for _ in range(RUNS):
        start = time.perf_counter()
        run()
        runs.append(time.perf_counter() - start)
    return round(statistics.median(runs), 3)


def main() -> None:
    spark = build_session(
        "threadline-bench",
        master=f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog = Catalog(spark, SF_DIR)
    objects = catalog.objects.count()  # also writes the derived tables, outside the timings
    timings: dict[str, float] = {}
    characters = catalog.definitions.agg(F.sum(F.length("definition"))).first()[0]
    for name in HEADLINE:
        timings[name] = _median(lambda name=name: checks.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save())
        print(name, timings[name], file=sys.stderr, flush=True)
    for name, prepare in (("layers_5_percent", _incremental), ("kept_index_search", _kept_search)):
        timings[name] = _median(prepare(catalog))
        print(name, timings[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": Path(SF_DIR).name.removeprefix("sf"),
                "objects": objects,
                "definition_characters": characters,
                "cpus": int(CPUS),
                "runs": RUNS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
