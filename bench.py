"""Headline queries at one scale; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from dataclasses import replace
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pickwise.plans import campaign as ca  # noqa: E402
from pickwise.plans import registry  # noqa: E402
from pickwise.plans import selection_queries as sel  # noqa: E402
from pickwise.session import get_spark  # noqa: E402

HEADLINE = [
    "benchmark_report", "enrichment_factor", "bedroc_truth", "agg_mean", "agg_median", "dedupe_obs", "candidate_fold",
    "candidate_marks", "tanimoto_max", "pareto_front", "hypervolume_2d", "acq_greedy", "acq_ucb", "acq_pending", "feasible",
    "align_library", "assign_pool_idx", "job_stats", "plate_layout", "round_history", "pair_fingerprint", "stream_labels",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark("bench", f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    registry.load()
    times: dict[str, float] = {}
    quality: dict[str, dict] = {}

    def clock(name: str, run) -> object:
        start = time.perf_counter()
        out = run()
        times[name] = round(time.perf_counter() - start, 3)
        return out

    registry.QUERIES["enrichment_factor"](spark, sf_dir).collect()  # session warm-up
    for name in HEADLINE:
        clock(name, lambda: registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())

    # the published enrichment comparison: one library, five rounds of fifty, 40 trees
    candidates, truth = clock("fingerprint_library", lambda: sel.text_library(spark, sf_dir))
    for s in ("random", "greedy", "ucb"):
        rules = replace(sel.ENRICHMENT, acquisition=s, surrogate="trees")  # 300 labels: the surrogate for small budgets

        def loop():
            labels = ca.run_campaign(candidates, ca.evaluate_from(truth, ["activity"]), rules, 5)
            return ca.history(truth, labels, ["activity"], rounds=False).first()

        row = clock(f"enrichment_{s}", loop)
        quality[s] = {k: row[k] for k in ("n_labeled", "top1_recall", "ef_top1", "bedroc")}
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": Path(sf_dir).name, "quality": quality,
    }))


if __name__ == "__main__":
    main()
