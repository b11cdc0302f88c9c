"""Quality by a document classifier and hierarchical empirical Bayes over sites.

A logistic classifier on the shape of a text (cases, symbols, repeats, lengths) gives each document's
evidence. Evidence is summed by path and host; a host's rate is drawn to the global rate, and a path's
rate to its host's, by prior strengths that the between-host and between-path variances give (method of
moments). A sparse site so stays near the prior. A document's posterior log odds are its own plus what
its path's rate adds to the global one, weighed by `trust`.

The host of a document is its source, and its path the language section under it. Sums are of whole
millionths, so that reruns agree. The classifier is fitted on a sample of at most SAMPLE labelled
documents (the first by hash of doc_id); everything else covers all documents.

Null and empty texts are judged by the same features, all zero. A null source or language is a site of
its own. Labels without a document or with a null are passed over; without labels of both kinds the
evidence is one half for all. Repeated rows count each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, arrow_schema, written
from .kernel import BLANK_SPLIT, Words, blocks
from .op05_fertility import dup_lines, repeated_words

SAMPLE = 6000
TRUST = 0.5
RIDGE = 1.0
FEATURES = ["log_words", "word_bytes", "upper", "digit", "symbol", "bang", "bar", "stop", "other", "high", "dup_lines", "repeat_words", "short_lines"]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    words = Words(data, offsets, BLANK_SPLIT)
    size = np.maximum(np.diff(offsets), 1)
    many = np.maximum(words.count, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / size

    letters = ((data >= 97) & (data <= 122)) | (data >= 128)
    upper = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    symbol = np.isin(data, np.frombuffer(b"#*$%&<>@^~_=+\\/{}[]", dtype=np.uint8))
    bang, bar, stop = data == 33, data == 124, np.isin(data, np.frombuffer(b".,;:?", dtype=np.uint8))
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    lines = share(data == 10) * size + 1
    return np.c_[
        np.log1p(words.count),
        np.bincount(words.doc, words.end - words.start, minlength=n) / many,
        share(upper), share(digit), share(symbol), share(bang), share(bar), share(stop),
        share(~(letters | upper | digit | symbol | bang | bar | stop | blank)),
        share(data >= 128),
        dup_lines(words, data, offsets) / lines,
        repeated_words(words, n) / many,
        np.minimum(lines / many, 1),
    ]


class Classifier:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.mean, self.scale, self.weights = mean, scale, weights

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        return np.clip(np.c_[z, np.maximum(z, 0) ** 2, np.ones(len(z))] @ self.weights, -12, 12)


def fit(texts: list[str], quality: list[int], ridge: float = RIDGE) -> Classifier:
    n = len(FEATURES)
    y = np.array(quality, dtype=float)
    if not len(y) or y.all() or not y.any():
        return Classifier(np.zeros(n), np.ones(n), np.zeros(2 * n + 1))
    x = np.concatenate([features(data, offsets) for _, _, data, offsets in blocks(pa.array(texts))])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = np.clip((x - mean) / scale, -4, 4)
    a = np.c_[z, np.maximum(z, 0) ** 2, np.ones(len(z))]
    w = np.zeros(a.shape[1])
    damp = ridge * np.eye(len(w))
    damp[-1, -1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + damp, a.T @ (p - y) + damp @ w)
        w = w - step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return Classifier(mean, scale, w)


def emit_odds(model: Classifier):
    schema = arrow_schema("doc_id long, host string, path string, odds double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.log_odds(features(data, offsets)) for _, _, data, offsets in blocks(batch.column(3))]
            odds = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(odds)], schema=schema)

    return run


def sample(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[list[str], list[int]]:
    few = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    few = F.broadcast(few.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(rows))  # at most `rows`
    found = docs.select("doc_id", "text").join(few, "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("quality").alias("quality")).orderBy("doc_id").collect()
    return [r["text"] or "" for r in found], [int(r["quality"]) for r in found]


def strength(rate: str, n: str, prior: str):
    """Prior strength of beta-distributed rates around `prior`, from their variance beyond what n explains."""
    spread = F.avg((F.col(rate) - F.col(prior)) ** 2)
    chance = F.avg(F.col(prior) * (1 - F.col(prior)) / F.col(n))
    between = F.greatest(spread - chance, F.lit(1e-6))
    return F.least(F.greatest(F.avg(F.col(prior) * (1 - F.col(prior))) / between - 1, F.lit(1.0)), F.lit(1e4))


def posterior(scored: DataFrame, trust: float = TRUST) -> DataFrame:
    """scored (doc_id, host, path, odds) with the rates and the posterior; null hosts and paths are sites."""
    evidence = F.round(1e6 / (1 + F.exp(-F.col("odds")))).cast("long")
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(evidence).alias("good"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("good").alias("hgood")).withColumn("raw", F.col("hgood") / F.col("hn") / 1e6)
    overall = hosts.agg((F.sum("hgood") / F.sum("hn") / 1e6).alias("all_rate"))  # one row
    hosts = hosts.crossJoin(F.broadcast(overall))
    host_strength = hosts.agg(strength("raw", "hn", "all_rate").alias("hs"))  # one row
    hosts = hosts.crossJoin(F.broadcast(host_strength)).withColumn("host_rate", (F.col("hgood") / 1e6 + F.col("hs") * F.col("all_rate")) / (F.col("hn") + F.col("hs")))
    sites = paths.alias("p").join(hosts.alias("h"), F.expr("p.host <=> h.host")).select("p.host", "p.path", "p.n", "p.good", "h.all_rate", "h.host_rate").withColumn("raw", F.col("good") / F.col("n") / 1e6)
    path_strength = sites.agg(strength("raw", "n", "host_rate").alias("ps"))  # one row
    sites = sites.crossJoin(F.broadcast(path_strength)).withColumn("path_rate", (F.col("good") / 1e6 + F.col("ps") * F.col("host_rate")) / (F.col("n") + F.col("ps")))
    logit = lambda c: F.log(F.least(F.greatest(F.col(c), F.lit(1e-4)), F.lit(1 - 1e-4)) / (1 - F.least(F.greatest(F.col(c), F.lit(1e-4)), F.lit(1 - 1e-4))))
    sites = sites.select("host", "path", "host_rate", "path_rate", (logit("path_rate") - logit("all_rate")).alias("adds"))
    out = scored.alias("d").join(sites.alias("s"), F.expr("d.host <=> s.host AND d.path <=> s.path")).select("d.doc_id", "d.host", "d.path", "d.odds", "s.host_rate", "s.path_rate", "s.adds")
    return out.withColumn("score", 1 / (1 + F.exp(-(F.col("odds") + trust * F.col("adds"))))).drop("adds")


def rate_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, trust: float = TRUST) -> DataFrame:
    """doc_id, host_rate, path_rate, score and kept (score of one half or more) of each row."""
    model = fit(*sample(docs, labels, rows))
    column = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), column("source").alias("host"), column("lang").alias("path"), "text")
    scored = written(arrow_map(plain, emit_odds(model), "doc_id long, host string, path string, odds double"), "odds")
    return posterior(scored, trust).select("doc_id", "host", "path", "host_rate", "path_rate", "score", (F.col("score") >= 0.5).alias("kept"))
