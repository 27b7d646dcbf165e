"""Headline queries on ``$BENCH_SF_DIR``; prints one JSON line.

Loading the corpus (the star-schema tables laid out as triples) is timed on its
own, as ``load``; every query then starts from the loaded triples.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from quercus.plans import queries as Q
from quercus.plans.starmap import load

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = [
    "J8_straddle_lint",
    "J4_closure",
    "J2_entry_points",
    "A6_counts",
    "A7_W11_profile",
    "A2_individuals",
    "GA1_GA5_structure",
    "J9_orphans",
    "J10_gate_straddles",
    "J11_mistyped",
    "Grun_failures",
    "M1_class_hierarchy",
    "M2_entailed_types",
    "M3_unsatisfiable_reasons",
    "M4_inconsistent_individuals",
    "R3_fix_all",
    "F1_F2_W9_theory_classes",
    "F10_class_emptiness",
    "F7_prover9_lines",
    "E7_verdicts",
    "B4_B8_violations",
    "L1_typed_axioms",
    "S1_ntriples_round_trip",
    "P6_P7_name_antipatterns",
    "W1_latest_per_file",
    "T2_verdict_windows",
]


def main():
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    start = time.time()
    for family in ("tbox", "abox"):
        load(spark, SF_DIR, family)
    times["load"] = round(time.time() - start, 3)
    for name in HEADLINES:
        start = time.time()
        Q.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds over headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
