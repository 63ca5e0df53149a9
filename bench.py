"""Wall time of the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every query is run to the end with a sink that discards the rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "scan_filtered",
    "filter_text_length",
    "limit_per_group",
    "weighted_sample_rows",
    "normalize_text",
    "strip_markup_artifacts",
    "sentence_chunks",
    "text_metrics",
    "word_table",
    "tokenize_with_offsets",
    "metrics_overall",
    "metrics_grouping_sets",
    "paired_samples",
    "group_documents",
    "matched_unmatched_rows",
    "merge_by_text",
    "self_similarity",
    "span_range_overlap",
    "stratified_split",
    "matched_split",
    "cv_rotation",
    "binary_metrics",
    "auroc_by_source",
    "threshold_at_fpr",
    "multiclass_macro",
    "sliding_token_windows",
    "rolling_prefix_windows",
    "sentence_token_spans",
    "span_labels",
    "ngram_counts",
    "token_likelihoods",
    "llr_score",
    "cross_entropy_ratio",
    "filter_continuations",
    "mean_pool",
    "trajectory_spectrum",
    "export_jsonl_bz2",
    "extract_article_html",
    "standoff_covered_text",
    "logistic_multinomial",
    "stream_features",
]


def main() -> None:
    from textloom.plans import QUERIES
    from textloom.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()  # start the executor threads
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
