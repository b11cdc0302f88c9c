"""Pluggable models and file sinks: embedding and scoring by batches, error logs, evaluation results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts that a model gets at once, and the most characters of a scored batch and document.
EMBED_BATCH, RERANK_CHARS, RERANK_DOC = 64, 8000, 1024


def hash_embedder(texts: list[str]) -> list[list[float]]:
    """The offline default."""
    import hashlib

    return [[(b - 128) / 128 for b in hashlib.sha256(t.encode()).digest()] for t in texts]


def halving(f: Callable[[list], list], items: list, depth: int = 3) -> list:
    """f of items; a batch that fails is halved, and what still fails gives None."""
    try:
        return f(items)
    except Exception:
        if depth == 0 or len(items) < 2:
            return [None] * len(items)
        half = len(items) // 2
        return halving(f, items[:half], depth - 1) + halving(f, items[half:], depth - 1)


def embed(df: DataFrame, key: str, text: str, model: Callable[[list[str]], list[list[float]]] = hash_embedder, batch: int = EMBED_BATCH) -> DataFrame:
    """(key, vec): vectors of texts in batches; one that the model fails for is null."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = part[text].fillna("").tolist()
            vecs = [v for i in range(0, len(texts), batch) for v in halving(model, texts[i : i + batch])]
            yield pd.DataFrame({key: part[key], "vec": vecs})

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInPandas(run, f"{key} {kind}, vec array<double>")


def embed_missing(texts: DataFrame, cache: DataFrame, model: Callable = hash_embedder) -> DataFrame:
    """(key, vec): what the cache has, and the model for the rest only."""
    have = texts.select("key", "text").join(cache.select("key", "vec"), "key", "left")
    return have.filter("vec IS NOT NULL").select("key", "vec").unionByName(embed(have.filter("vec IS NULL"), "key", "text", model))


def score_pairs(df: DataFrame, scorer: Callable[[list[tuple[str, str]]], list[float]]) -> DataFrame:
    """(q_id, memory_id, score) of (q_id, memory_id, query, text), in batches of bounded characters."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            pairs = [(q, t[:RERANK_DOC]) for q, t in zip(part["query"], part["text"].fillna(""), strict=True)]
            scores, held, size = [], [], 0
            for p in pairs:
                if held and size + len(p[1]) > RERANK_CHARS:
                    scores += halving(scorer, held)
                    held, size = [], 0
                held.append(p)
                size += len(p[1])
            scores += halving(scorer, held) if held else []
            yield pd.DataFrame({"q_id": part["q_id"], "memory_id": part["memory_id"], "score": scores})

    return df.mapInPandas(run, "q_id long, memory_id string, score double")


def read_vault(spark: SparkSession, path: str) -> DataFrame:
    """(date, line, entry) of a vault: a file of JSON lines for each day, named by it; blank lines are left out."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), "(\\d{4}-\\d{2}-\\d{2})", 1).alias("date"), F.posexplode(F.split("value", "\\r?\\n")).alias("line", "entry"))
    return files.filter("date <> '' AND trim(entry) <> ''").select("date", (F.col("line") + 1).alias("line"), "entry")


def scan_files(spark: SparkSession, path: str, forbidden: dict[str, str], most_bytes: int) -> DataFrame:
    """(file, problem) of files that hold a forbidden pattern, by its name, or are too large."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = F.decode("content", "ISO-8859-1")
    named = [F.when(F.col("length") > most_bytes, "size"), *[F.when(text.rlike(pattern), name) for name, pattern in forbidden.items()]]
    return files.select(F.col("path").alias("file"), F.explode(F.array_compact(F.array(*named))).alias("problem"))


def write_evaluation(answers: DataFrame, meta: dict, path: str) -> None:
    """Answers as JSON lines, and one line about the run beside them."""
    answers.write.mode("overwrite").json(f"{path}/answers")
    answers.sparkSession.createDataFrame([{k: str(v) for k, v in meta.items()}]).coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def log_errors(df: DataFrame, path: str) -> None:
    """Errors with their time `ts`, as JSON lines by day."""
    df.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").json(path)


def read_errors(spark: SparkSession, path: str, schema: str, n: int = 100) -> DataFrame:
    return spark.read.schema(schema).json(path).orderBy(F.col("ts").desc()).limit(n)


def health(spark: SparkSession, model: Callable = hash_embedder) -> dict:
    """The session's settings, and whether the embedder answers a real call."""
    try:
        ok = len(model(["ping"])[0]) > 0
    except Exception:
        ok = False
    return {"ok": ok, "spark": spark.version, "time_zone": spark.conf.get("spark.sql.session.timeZone"), "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions")}
