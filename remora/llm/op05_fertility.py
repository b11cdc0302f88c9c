"""Quality rules by tokeniser fertility.

A public vocabulary with byte fallback splits every word of a text (each on its own, after a word
start). Three measures follow: characters per token, the share of tokens that are fallback bytes, and
the entropy of the text's tokens over what as many tokens could have at most. Each language (its script, where the
language is null) gets bands from whole-corpus histograms: a measure may lie `reach` times the distance
between the 5th and 95th hundredth outside them. A text outside any band is rejected, as is one that
fails the base rules.

The bands come from all texts that pass the base rules, by histograms with a fixed grid, which merge
exactly: reruns agree. A null or blank text has no words and fails the base rules. Repeated rows are
rows of their own; other columns are ignored. A missing lang column counts as null.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, arrow_schema, written
from .kernel import BLANK_SPLIT, Hasher, Words, blocks, ragged

VOCABULARY = os.environ.get("REMORA_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")
SYMBOLS = b"#*$%&|<>"
REACH = 0.75
GRID = 200
MIN_WORDS = 50
#: Words whose tokens a task remembers at most.
REMEMBERED = 400_000

MEASURES = "row long, doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, entropy double"


class Splitter:
    """Tokens of words, remembered by the words' hashes."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.vocab_size())])
        self.known: dict[int, np.ndarray] = {}

    def of(self, hashes: np.ndarray, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        keys = hashes.tolist()
        new = [i for i, h in enumerate(keys) if h not in self.known]
        if new:
            for i, ids in zip(new, self.pieces.encode([texts[i] for i in new], num_threads=1), strict=True):
                self.known[keys[i]] = np.array(ids, dtype=np.int32)
        return [self.known[h] for h in keys]


def equal_before(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """True where an earlier entry of the same group has the same value."""
    order = np.lexsort((np.arange(len(value)), value, group))
    out = np.zeros(len(value), dtype=bool)
    out[order[1:]] = (group[order][1:] == group[order][:-1]) & (value[order][1:] == value[order][:-1])
    return out


def repeated_words(words: Words, n_docs: int, width: int = 3) -> np.ndarray:
    """Words inside a window of three that the text has twice or more, by document."""
    first, h = words.grams(width)
    order = np.lexsort((h, words.doc[first]))
    f, g, d = first[order], h[order], words.doc[first][order]
    same = np.zeros(len(f) + 1, dtype=bool)
    same[1:-1] = (g[1:] == g[:-1]) & (d[1:] == d[:-1])
    twice = f[same[:-1] | same[1:]] if len(f) else f
    inside = np.zeros(len(words.start), dtype=bool)
    for i in range(width):
        inside[twice + i] = True
    return np.bincount(words.doc[inside], minlength=n_docs)


def dup_lines(words: Words, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text, by document."""
    breaks = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    start = start[start < len(data)]
    doc = np.searchsorted(offsets, start, side="right") - 1
    end = np.append(start[1:], len(data))
    # a line ends before its \n, which the last line of a text may lack
    end = end - ((end > start) & (data[end - 1] == 10)) if len(end) else end
    has_word = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, doc = start[has_word], end[has_word], doc[has_word]
    again = equal_before(doc, Hasher(data).spans(start, end)) if len(start) else np.zeros(0, bool)
    return np.bincount(doc[again], minlength=len(offsets) - 1)


def measure(model: bytes):
    schema = arrow_schema(MEASURES)
    is_symbol = np.zeros(256, dtype=bool)
    is_symbol[list(SYMBOLS)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(model)
        for batch in batches:
            parts = []
            for _, j, data, offsets in blocks(batch.column(3)):
                n = len(offsets) - 1
                words = Words(data, offsets, BLANK_SPLIT)
                lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                chars = np.bincount(words.doc, lead[words.end] - lead[words.start], minlength=n).astype(np.int64)
                symbols = np.concatenate([[0], np.cumsum(is_symbol[data])])
                _, one, back = np.unique(words.hash, return_index=True, return_inverse=True)
                raw = data.tobytes()
                tokens = splitter.of(words.hash[one], [raw[words.start[i] : words.end[i]].decode("utf-8", "replace") for i in one])
                size = np.array([len(t) for t in tokens], dtype=np.int64)
                flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
                begin = np.cumsum(size) - size
                row, step = ragged(size[back])
                token = flat[begin[back][row] + step]
                doc = words.doc[row]
                total = np.bincount(doc, minlength=n)
                fallback = np.bincount(doc[splitter.is_byte[token]], minlength=n)
                pair = np.sort(doc * np.int64(1 << 32) + token)
                new = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, np.int64)
                count = np.diff(np.append(new, len(pair)))
                owner = pair[new] >> 32
                with np.errstate(divide="ignore", invalid="ignore"):
                    share = count / total[owner]
                    entropy = np.bincount(owner, -share * np.log2(share), minlength=n) / np.log2(np.maximum(2, total))
                    per_token = np.where(total > 0, chars / total, 0.0)
                    bytes_share = np.where(total > 0, fallback / total, 0.0)
                parts.append((words.count, chars, symbols[offsets[1:]] - symbols[offsets[:-1]], dup_lines(words, data, offsets), repeated_words(words, n), total, per_token, bytes_share, entropy))
            if parts:
                columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *[pa.array(c, type=f.type) for c, f in zip(columns, list(schema)[3:], strict=True)]], schema=schema)

    return run


def bands(measured: DataFrame, reach: float, grid: int = GRID) -> DataFrame:
    """Per language: the lowest and highest value allowed of each measure."""
    good = measured.filter("NOT base_failed")
    cells = good.select("tongue", F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.round(F.col(c) * grid).cast("long").alias("cell")) for c in ("chars_per_token", "byte_share", "entropy")])).alias("x"))
    counts = cells.groupBy("tongue", "x.what", "x.cell").agg(F.count("*").alias("n"))
    by = Window.partitionBy("tongue", "what")
    counts = counts.withColumn("upto", F.sum("n").over(by.orderBy("cell"))).withColumn("all", F.sum("n").over(by))
    edge = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("cell"))) / grid
    found = counts.groupBy("tongue", "what").agg(edge(0.05).alias("low"), edge(0.95).alias("high"))
    width = F.greatest(F.col("high") - F.col("low"), F.lit(2.0 / grid))
    return found.groupBy("tongue").agg(*[F.max(F.when(F.col("what") == c, F.struct((F.col("low") - reach * width).alias("low"), (F.col("high") + reach * width).alias("high")))).alias(f"{c}_band") for c in ("chars_per_token", "byte_share", "entropy")])


def rate_fertility(docs: DataFrame, vocabulary: str = VOCABULARY, reach: float = REACH) -> DataFrame:
    """Per row: doc_id, the counts of the base rules, the measures, base_failed and kept."""
    with open(vocabulary, "rb") as f:  # read once on the driver, sent with the tasks
        model = f.read()
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    plain = docs.select(F.lit(0).cast("long").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(lang, F.when(F.col("text").rlike("[\\u0370-\\u1FFF\\u3040-\\uD7AF]"), "other script").otherwise("latin script")).alias("lang"), "text")
    measured = arrow_map(plain, measure(model), MEASURES)
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    measured = written(measured.withColumn("base_failed", failed).withColumnRenamed("lang", "tongue").drop("row"), "fertility")
    limits = bands(measured, reach)
    ok = F.lit(True)
    for c in ("chars_per_token", "byte_share", "entropy"):
        ok = ok & F.coalesce((F.col(c) >= F.col(f"{c}_band.low")) & (F.col(c) <= F.col(f"{c}_band.high")), F.lit(True))
    joined = measured.join(limits, "tongue", "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ok).alias("kept"), "n_tokens", "chars_per_token", "byte_share", "entropy", F.col("tongue"))
