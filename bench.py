"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
NAMES = ("norm_bert", "pretok_gpt2", "pretok_bytelevel", "bpe_encode", "bytelevel_bpe_encode", "charbpe_encode", "wordpiece_encode", "unigram_encode", "tok_encoding", "tok_decode_raw", "decode_cleanup", "train_word_counts", "train_pair_counts", "chat_chatml", "e2e_tokens_per_lang")


def main() -> None:
    from pyspark.sql import SparkSession

    from sparklex import queries

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf}/documents.parquet").selectExpr("max(length(text))").collect()
    made = queries.queries()
    took = {}
    for n in NAMES:
        began = time.perf_counter()
        made[n](spark, sf).write.format("noop").mode("overwrite").save()
        took[n] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
