"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR picks the data, BENCH_CPUS the local cores, BENCH_QUERIES (comma
separated) other queries.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from lexispark.catalog import QUERIES  # noqa: E402
from lexispark.session import local_session  # noqa: E402

HEADLINE = [
    "dedup_paragraphs",
    "dedup_documents",
    "web_corpus_clean",
    "filter_charset_window",
    "sentence_split",
    "normalize_tokens",
    "route_words",
    "term_vocabulary",
    "inverted_index",
    "piece_vocabulary",
    "pack_sequences",
    "merge_runs",
    "roll_features",
    "series_gap_fill",
    "mean_vectors",
    "topk_similar",
    "dep_graph_edges",
    "projectivity",
    "pagerank",
    "extract_main_text",
    "index_feed",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, app="bench")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("filter_bad_rows")  # start the engine before the clock
    times = {name: round(run(name), 3) for name in names}
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
