"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from relafix.plans import catalogue
from relafix.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
HEADLINE = ("reachability", "cyclic_reachability", "topological_depth", "reaching_definitions", "live_locals", "last_definition", "taint_with_kill", "must_merge", "lattice_or", "dead_members", "dispatch", "provenance_path", "entailment", "score_report", "degrees", "taint_leaks", "points_to")


def main() -> None:
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.QUERIES[HEADLINE[0]](spark, SF_DIR).count()  # starts the JVM's machinery
    took = {}
    for name in HEADLINE:
        start = time.time()
        catalogue.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
