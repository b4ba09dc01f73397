"""Time the headline queries and print one JSON line.

Reads ``BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[BENCH_CPUS]``.
Each query is built, planned and run to its last row; the derived
corpora are written before the clock starts, as real input tables would be.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "coverage_summary", "scan_text", "scan_pages", "scan_conversations", "scan_provider", "scan_generic", "scan_entropy",
    "scan_k8s_secret", "yaml_secret_windows", "scan_file_content", "scan_change_set", "xref_dotenv_large", "decode_blob",
    "split_lines", "parse_raw_log", "introduce_versions", "classify_versions", "scan_whole_history", "history_coverage",
    "stream_scan",
]


def main() -> None:
    from leakscan import corpora
    from leakscan.queries import QUERIES, stored_corpus

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("leakscan-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="leakscan-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    names = sys.argv[1:] or HEADLINE
    for corpus in [n for n, c in vars(corpora).items() if isinstance(c, corpora.Corpus)]:
        stored_corpus(spark, SF_DIR, corpus)
    for name in ("scan_pages", "parse_raw_log"):  # start the workers, store the logs
        run(name)
    seconds = {name: round(run(name), 3) for name in names}
    size = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline query time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(size) if size.replace(".", "").isdigit() else size,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
