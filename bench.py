"""Headline queries, each the median of three runs after a warm-up (one run from SLOW seconds on); prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalogops import plans  # noqa: E402
from catalogops.session import build_session  # noqa: E402

HEADLINE = (
    "stage_timings", "decision_groups", "downsample_progress", "tail_events", "attribute_events", "count_string",
    "stage_stats", "derive_stage", "ready_tasks", "expected_work", "item_overview", "blocked_waits",
    "weighted_median", "majority_profile", "rank_references", "title_mention", "top_files", "prune_plan", "resolve_by_prefix",
    "parse_log_lines", "best_stream", "clean_cues", "cue_qc_stats", "text_anchors", "interval_overlap", "adopt_first_passing",
    "segment_medians", "runtime_fit", "anomalies", "episode_stats", "primary_title", "composite_titles",
    "top_match_per_document", "score_pairs", "claims", "assign_one_to_one", "near_duplicate_documents",
)
SLOW = 5.0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.log.level": "ERROR"})
    queries = plans.queries()

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("stage_stats")
    times: dict[str, float] = {}
    for name in HEADLINE:
        seen = [run(name)]
        if seen[0] < SLOW:
            seen += [run(name), run(name)]
        times[name] = round(statistics.median(seen), 3)
        print(name, times[name], len(seen), file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
