"""Timings of the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores). Every query is written to the
no-op sink, so all rows are computed and nothing is collected. Each query runs twice and the
second time counts: the first one pays for class loading and Python worker start.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from eventide.operators import segment as G  # noqa: E402
from eventide.plans import catalog  # noqa: E402
from eventide.session import local_session  # noqa: E402
from eventide.sources import tables  # noqa: E402

HEADLINE = [
    "cosine_sweep", "jaccard_sweep", "segment_frequent", "segment_persistent", "grid_gauss",
    "variant_best", "anchor_best", "signal_top15", "segment_report", "context_sweep", "event_run",
    "event_surprise", "event_tokens", "topic_moments", "running_scores", "label_logprob", "subject_rpb",
    "permutation_null", "bind", "cleanup_topk", "trace_posterior", "linear_dynamics", "stream_segment",
]
#: Copies of the scene table (fresh sequence keys) for the throughput figures.
COPIES = 500
GRID_COPIES = 20


def replicated(spark, sf_dir, copies):
    scenes = tables.short_scenes(spark, sf_dir)
    copy = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    return scenes.withColumn("copy", copy).withColumn(
        "seq_id", F.col("seq_id") * copies + F.col("copy")
    ).drop("copy")


def timed(build) -> float:
    best = None
    for _ in range(2):
        t0 = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        best = time.perf_counter() - t0
    return best


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), memory=os.environ.get("BENCH_MEMORY", "12g"))
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        times[name] = round(timed(lambda: catalog.QUERIES[name](spark, sf_dir)), 3)
    rows = tables.short_scenes(spark, sf_dir).count()
    times["segment_replicated"] = round(
        timed(lambda: G.segment(replicated(spark, sf_dir, COPIES), G.FREQUENT_SHIFT)), 3
    )
    times["grid_replicated"] = round(
        timed(lambda: G.grid_scores(replicated(spark, sf_dir, GRID_COPIES), G.gauss_grid())), 3
    )
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    configs = len(G.gauss_grid())
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else sf_dir,
                "derived": {
                    "segment_ms_per_turn": round(times["segment_replicated"] * 1000 / (rows * COPIES), 6),
                    "grid_sec_per_config": round(times["grid_gauss"] / configs, 5),
                    "grid_turns": rows,
                    "grid_us_per_turn_and_config": round(
                        times["grid_replicated"] * 1e6 / (rows * GRID_COPIES * configs), 4
                    ),
                },
            }
        )
    )


if __name__ == "__main__":
    main()
