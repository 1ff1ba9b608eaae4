"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

import workload

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "url_intake", "dedupe_submissions", "registrable_domains", "lexical_risk_scores", "page_text", "page_state_hashes",
    "form_fields", "certificate_evidence", "misp_summary", "opencti_summary", "redirect_evidence", "cloaking",
    "deduped_states", "leaf_states", "evidence_bundles", "final_verdicts", "listing_page", "latest_runs",
    "cached_verdicts", "override_matches", "root_paths", "long_root_paths", "bounded_exploration", "case_digests",
    "streamed_verdict_cache", "risk_listing", "runs_at_request_time", "deep_listing_page", "exported_documents",
)


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    spark, times = session(), {}
    spark.read.parquet(f"{FOLDER}/pages.parquet").count()
    for name in HEADLINE:
        started = time.perf_counter()
        workload.QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    scale = FOLDER.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(scale) if scale.replace(".", "").isdigit() else scale,
    }))


if __name__ == "__main__":
    main()
