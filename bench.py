"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from blockquery.plans import catalogue
from blockquery.session import build_session

HEADLINE = (
    "decision_summary", "block_scan", "redact_text", "rule_evidence", "export_pivot", "evidence_bm25", "evidence_packs", "page_quality", "ledger_rollup", "step_timing_pivot",
    "eval_summary", "weighted_metric", "bbox_iou_pairs", "budgeted_context", "config_integrity", "table_cells_kv", "html_payload_scan", "duplicate_text",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", cpus=int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    known = catalogue.queries()
    known["block_scan"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # compile and warm once
    took = {}
    for name in HEADLINE:
        began = time.time()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
