"""The registered queries opN_<name>, each over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chatrepair import repair
from .embed import near
from .langid import language
from .lmscore import lm_scores
from .mixing import mix_plan
from .secrets import MORE, RULES, secrets
from .simhash import simhash_components
from .substring import substring_dedup
from .tiling import contaminated
from .toxicity import toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(_read(spark, sf_dir, "documents"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(_read(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(_read(spark, sf_dir, "documents"))


def op4_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(_read(spark, sf_dir, "conversations"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("tiles")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_read(spark, sf_dir, "documents")).drop("kept")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = simhash_components(_read(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_read(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(_read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_secret_scan, op2_source_mix, op3_language_id, op4_chat_repair, op5_decontamination, op6_toxicity, op7_substring_dedup, op8_simhash_dedup, op9_lm_score, op10_embedding_dedup)
    return {f.__name__: f for f in made}


def _op1_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    hits, spans = [], []
    for i, r in enumerate(RULES):
        p = quote(r.pattern)
        hits.append(f"regexp_extract_all(t, {p}) AS h{i}, regexp_extract_all(t, {p}, {r.group}) AS g{i}, string_split_regex(t, {p}) AS p{i}")
        start = f"(list_sum(list_transform(p{i}[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(h{i}[1:k-1], lambda x: length(x))), 0))::BIGINT"
        spans.append(f"list_transform(list_filter(range(1, len(h{i}) + 1), lambda k: length(g{i}[k]) >= {r.least}), lambda k: {{'s': {start}, 'n': {i}, 'x': '{r.kind}:' || {start} || ':' || ({start} + length(h{i}[k]))}}) AS s{i}")
    shown = lambda x: f"array_to_string(list_transform(list_sort({x}), lambda y: y.x), ',')"
    cat = lambda n: "list_concat(" * (n - 1) + "s0" + "".join(f", s{i})" for i in range(1, n))
    n = len(RULES) - len(MORE)
    counts = ", ".join(f"len(s{i})::BIGINT AS n_{RULES[i].kind}" for i in range(n))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
h AS (SELECT doc_id, {", ".join(hits)} FROM d),
s AS (SELECT doc_id, {", ".join(spans)} FROM h)
SELECT doc_id, {counts}, sha256({shown(cat(n))}) AS base_sha256, {shown(cat(len(RULES)))} AS spans FROM s"""


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": _op1_sql(), "op10_embedding_dedup": OP10_SQL}


OP10_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT a, a AS c FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
m AS (SELECT a, min(c) AS c FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id)::BIGINT AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN m ON vec_id = m.a"""
