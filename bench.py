"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from foliospark.plans import registry  # noqa: E402
from foliospark.session import local_session  # noqa: E402

HEADLINE = [
    "invoice_fields",
    "extract_by_class",
    "fix_ocr",
    "choose_ocr",
    "word_count",
    "structural_features",
    "vocabulary",
    "tfidf",
    "detect_language",
    "stratified_split",
    "incremental_text",
    "api_response",
    "predict",
    "classify_documents",
]


# Training-text queries, timed where their folder is present.
TRAINING_TEXT = ["op2_line_dedup", "op8_exact_dedup", "op11_conversation_trie", "op12_token_counts", "op13_embedding_whitening"]


def training_text_jobs() -> dict:
    try:
        import foliospark.llm.queries as training_text
    except ModuleNotFoundError as missing:
        if missing.name not in ("foliospark.llm", "foliospark.llm.queries"):
            raise
        return {}
    return {name: training_text.QUERIES[name] for name in TRAINING_TEXT if name in training_text.QUERIES}


# Tables whose rows take much work each.
TEXT_TABLES = ["documents", "pages", "conversations", "embeddings"]


def dealt_out(spark, name: str, path: str):
    """The small test tables are one split each; their rows are dealt out so that all cores are measured."""
    rows = spark.read.parquet(path)
    return rows.repartition(spark.sparkContext.defaultParallelism) if name in TEXT_TABLES else rows


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, os.environ.get("BENCH_MEMORY", "12g"), "bench")
    jobs = registry.queries(lambda name, path: dealt_out(spark, name, path))
    spark.read.parquet(f"{folder}/documents.parquet").count()  # start the executors
    seconds = {}
    jobs |= training_text_jobs()
    for name in HEADLINE + [n for n in TRAINING_TEXT if n in jobs]:
        start = time.perf_counter()
        jobs[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    result = {
        "metric": "total wall-clock of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
