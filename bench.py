"""Time the headline queries: each once to warm up, then once more, which counts.

Prints one JSON line.  BENCH_SF_DIR and BENCH_CPUS choose the tables and the number of threads.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), os.environ.get("PYTHONPATH", "")]))

#: The reference's own set of searches (word, accents, alternatives, phrase, typos, exclusion), then wider ones.
HEADLINE = (
    "word_search", "accent_fold_search", "or_group", "phrase_search", "fuzzy_word", "like_word", "not_word", "multi_word_and", "partial_word", "case_sensitive_word", "regex_search", "near_words", "lines_range",
    "term_list_any", "term_list_5000", "bm25_topk", "search_hits", "inflected_word", "facets_without_own_filter", "facets_with_dates", "keyword_report", "exact_dups", "detect_email", "detect_totals", "knn_passages", "knn_all_questions", "rrf_fusion", "manifest_changed", "debounce_sessions",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from textloom.catalog import QUERIES, indexed

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", "2m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    began = time.perf_counter()
    indexed(spark, sf_dir)  # searches are those of an index that is there already
    built = round(time.perf_counter() - began, 3)
    for name in HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "index_build_seconds": built, "sf": Path(sf_dir).name}))
    spark.stop()


if __name__ == "__main__":
    main()
