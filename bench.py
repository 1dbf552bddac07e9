"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of the tables, BENCH_CPUS the number of cores, BENCH_QUERIES an
optional comma list of queries.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from corpuslab.plans.catalog import QUERIES
from corpuslab.session import build_session

HEADLINE = [
    "language_distribution", "balanced_languages", "quarter_class_pivot", "quarter_keyword_pivot",
    "topic_language_share", "top3_keywords_by_language", "top_publishers", "tokenize", "sentences",
    "ngram_counts", "cue_url_filter", "stratified_split", "random_split", "stratified_kfold",
    "topic_holdout", "temporal_split", "bow_counts", "encode_fixed", "naive_bayes",
    "grid_search_nb", "kfold_nb", "cross_dataset_grid", "linear_svm", "batch_score",
    "experiment_report", "cv_report", "collect_resolve", "collect_finalize",
    "collect_incremental", "scan_csv_roundtrip", "cross_topic_report", "temporal_report",
    "relative_drop", "grid_search_svm", "kfold_svm", "model_roundtrip", "svm_roundtrip", "scan_csv_split",
]


def copied(spark, folder: str, files: int) -> str:
    """A folder with the tables of ``folder``, each in ``files`` files."""
    target = tempfile.mkdtemp(prefix="bench-tables-")
    for name in sorted(os.listdir(folder)):
        if name.endswith(".parquet"):
            spark.read.parquet(f"{folder}/{name}").repartition(files).write.parquet(f"{target}/{name}")
    return target


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        app="bench",
        master=f"local[{cpus}]",
        shuffle_partitions=8 if cpus == "*" else int(cpus),
        spark__driver__memory="16g",
        spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    tables = copied(spark, folder, os.cpu_count() if cpus == "*" else int(cpus))
    # One untimed query, so that the first timed one does not pay for the start of the session.
    QUERIES["value_counts"](spark, tables).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, tables).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total query time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
