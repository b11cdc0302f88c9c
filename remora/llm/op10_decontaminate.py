"""Benchmark decontamination by a prefix-filtered set join, with exact containment in item-sized windows.

A window is `width` consecutive words of an item (a shorter item is one window). As a document holds a
window only if it holds all of the window's shingles, one shingle is the necessary prefix: the one that
is rarest among the documents, by counts over all of them. A document's shingles are looked up among
these prefixes; a hit at word j for a prefix at place o of its window proposes a start j - o, which must
lie inside the document with room for the whole window (positional and length bounds), and is then
verified word by word.

The items are a stated query set. They are handled in blocks of at most `block_windows` windows, each
of which is sent to the tasks as a few arrays of known size; every block meets every document. With one
block, documents are never shuffled.

Null or blank texts have no words, are never contaminated, and an item without words matches nothing.
Items that share an item_id count as one (their windows unite); a null item_id is passed over. Repeated
documents are rows of their own. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, arrow_schema, keyed, with_ids
from .kernel import ALNUM_SPLIT, Words, blocks, gram_hash, ragged

WIDTH = 10
SHINGLE = 5
#: Windows sent to the tasks at once: at most about 100 bytes each.
BLOCK_WINDOWS = 200_000
#: A word, before lower-casing.
WORD = re.compile(rb"[0-9A-Za-z\x80-\xFF]+")


class Windows:
    """The distinct windows of a block of items: words, length, and which items hold them."""

    def __init__(self, ids: list, texts: list[str | None], width: int):
        words, items = [], []
        names = sorted({str(i) for i in ids if i is not None})
        place = {name: i for i, name in enumerate(names)}
        for i, _, data, offsets in blocks(pa.array(texts, type=pa.string())):
            found = Words(data, offsets, ALNUM_SPLIT, lower=True)
            for d in range(len(offsets) - 1):
                own = found.hash[found.first[d] : found.first[d + 1]]
                if ids[i + d] is None or not len(own):
                    continue
                n = min(width, len(own))
                for s in range(len(own) - n + 1):
                    words.append(own[s : s + n])
                    items.append(place[str(ids[i + d])])
        self.names = names
        seen: dict[bytes, int] = {}
        self.holders: list[set[int]] = []
        self.words: list[np.ndarray] = []
        for w, item in zip(words, items, strict=True):
            at = seen.setdefault(w.tobytes(), len(seen))
            if at == len(self.words):
                self.words.append(w)
                self.holders.append(set())
            self.holders[at].add(item)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(shingle length, hash, window, place) of all shingles."""
        parts: list[tuple] = []
        for i, w in enumerate(self.words):
            n = min(size, len(w))
            h = gram_hash(w, n)
            parts.append((np.full(len(h), n), h, np.full(len(h), i), np.arange(len(h))))
        if not parts:
            none = np.zeros(0, np.int64)
            return none, none.view(np.uint64), none, none
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))  # type: ignore[return-value]


def found_in(sorted_keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_keys, values)
    at[at == len(sorted_keys)] = 0
    return at if not len(sorted_keys) else np.where(sorted_keys[at] == values, at, -1)


def count_shingles(wanted: dict[int, np.ndarray]):
    """How many documents hold each wanted shingle, by batch."""
    schema = arrow_schema("size int, h long, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {n: np.zeros(len(keys), np.int64) for n, keys in wanted.items()}
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                words = Words(data, offsets, ALNUM_SPLIT, lower=True)
                for n, keys in wanted.items():
                    first, h = words.grams(n)
                    at = found_in(keys, h)
                    pair = np.unique(words.doc[first[at >= 0]] * (len(keys) + 1) + at[at >= 0])
                    total[n] += np.bincount(pair % (len(keys) + 1), minlength=len(keys))
        for n, counts in total.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), n, np.int32)), pa.array(wanted[n][some].view(np.int64)), pa.array(counts[some])], schema=schema)

    return run


HITS = "k long, n_words long, hits array<long>, items array<string>"


def scan(windows: list[np.ndarray], holders: list[list[str]], prefix: list[tuple[int, int, int, int]]):
    """One row per document: its words, the runs that windows cover (start << 32 | end), and the items."""
    schema = arrow_schema(HITS)
    length = np.array([len(w) for w in windows], dtype=np.int64)
    top = int(length.max()) if len(length) else 1
    body = np.zeros((len(windows), top), dtype=np.uint64)
    for i, w in enumerate(windows):
        body[i, : len(w)] = w
    tables = {}
    for n in sorted({p[0] for p in prefix}):
        rows = sorted((h, w, o) for m, h, w, o in prefix if m == n)
        keys = np.array([r[0] for r in rows], dtype=np.uint64)
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        tables[n] = (keys[start], start, np.diff(np.append(start, len(rows))), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))

    def matches(words: Words, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word in the block, window) of the verified places."""
        starts, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, (keys, begin, many, window, place) in tables.items():
            first, h = words.grams(n)
            at = found_in(keys, h)
            first, at = first[at >= 0], at[at >= 0]
            row, step = ragged(many[at])
            w = window[begin[at][row] + step]
            s = first[row] - place[begin[at][row] + step]
            d = words.doc[first[row]]
            room = (s >= words.first[d]) & (s + length[w] <= words.first[d + 1])
            s, w = s[room], w[room]
            for j in range(top):
                more = length[w] > j
                right = np.ones(len(s), dtype=bool)
                right[more] = words.hash[s[more] + j] == body[w[more], j]
                s, w = s[right], w[right]
            starts.append(s)
            which.append(w)
        return np.concatenate(starts), np.concatenate(which)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            counts, hits, items = [], [], []
            for i, j, data, offsets in blocks(batch.column(1)):
                words = Words(data, offsets, ALNUM_SPLIT, lower=True)
                s, w = matches(words, j - i)
                doc = words.doc[s] if len(s) else s
                order = np.argsort(doc, kind="stable")
                edges = np.searchsorted(doc[order], np.arange(j - i + 1))
                for d in range(j - i):
                    own = order[edges[d] : edges[d + 1]]
                    counts.append(int(words.count[d]))
                    if not len(own):
                        hits.append([])
                        items.append([])
                        continue
                    at = s[own] - words.first[d]
                    edge = np.zeros(int(words.count[d]) + 1, np.int32)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + length[w[own]], -1)
                    covered = np.diff(np.r_[0, np.cumsum(edge[:-1]) > 0, 0])
                    hits.append([(int(a) << 32) | int(b) for a, b in zip(np.flatnonzero(covered == 1), np.flatnonzero(covered == -1), strict=True)])
                    items.append(sorted({x for i_w in set(w[own].tolist()) for x in holders[i_w]}))
            yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.int64()), pa.array(counts, type=pa.int64()), pa.array(hits, type=pa.list_(pa.int64())), pa.array(items, type=pa.list_(pa.string()))], schema=arrow_schema(HITS) if schema is None else schema)

    return run


def item_blocks(items: DataFrame, width: int, block_windows: int):
    """Blocks of (ids, texts) of block_windows windows at most; a longer item is cut in pieces that share width - 1 words."""
    rows = items.select(F.col("item_id"), F.coalesce("text", F.lit("")).alias("text")).filter("item_id IS NOT NULL").orderBy("item_id", "text")
    ids: list = []
    texts: list = []
    size = 0
    for row in rows.toLocalIterator():  # one partition at a time
        words = WORD.findall(row["text"].encode())
        for start in range(0, max(1, len(words) - width + 1), block_windows):
            piece = words[start : start + block_windows + width - 1]
            many = max(1, len(piece) - width + 1)
            if size + many > block_windows and ids:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(row["item_id"])
            texts.append(b" ".join(piece).decode("utf-8", "replace"))
            size += many
    if ids:
        yield ids, texts


def find_leaks(docs: DataFrame, items: DataFrame, width: int = WIDTH, shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items (sorted) and hits."""
    docs, unique = keyed(docs)
    found: DataFrame | None = None
    many = 0
    for ids, texts in item_blocks(items, width, block_windows):
        windows = Windows(ids, texts, width)
        size, h, window, place = windows.shingles(shingle)
        wanted = {int(n): np.unique(h[size == n]) for n in np.unique(size)}
        counts = arrow_map(docs.select("text"), count_shingles(wanted), "size int, h long, n long").groupBy("size", "h").agg(F.sum("n").alias("n")).collect() if wanted else []
        seen = {(r["size"], r["h"]): r["n"] for r in counts}
        rarest: dict[int, tuple] = {}
        for n, x, w, o in zip(size.tolist(), h.tolist(), window.tolist(), place.tolist(), strict=True):
            rank = (seen.get((n, int(np.uint64(x).view(np.int64))), 0), x, o)
            if w not in rarest or rank < rarest[w][0]:
                rarest[w] = (rank, (n, x, w, o))
        # a window whose rarest shingle no document holds occurs nowhere
        prefix = [p for rank, p in rarest.values() if rank[0]]
        holders = [[windows.names[i] for i in x] for x in windows.holders]
        part = arrow_map(docs.select("_k", "text"), scan(windows.words, holders, prefix), HITS)
        found = part if found is None else found.unionByName(part)
        many += 1
    if found is None:
        found = arrow_map(docs.select("_k", "text"), scan([], [], []), HITS)
    if many > 1:
        found = found.groupBy("k").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        runs = F.array_sort("hits")
        joined = F.aggregate(
            runs,
            F.array().cast("array<bigint>"),
            lambda done, x: F.when(
                (F.size(done) > 0) & (F.shiftright(x, 32) <= F.element_at(done, -1).bitwiseAND(F.lit(0xFFFFFFFF))),
                F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.shiftleft(F.shiftright(F.element_at(done, -1), 32), 32) + F.greatest(F.element_at(done, -1).bitwiseAND(F.lit(0xFFFFFFFF)), x.bitwiseAND(F.lit(0xFFFFFFFF))))),
            ).otherwise(F.concat(done, F.array(x))),
        )
        found = found.withColumn("hits", joined)
    items_sorted = F.array_sort("items")
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x.bitwiseAND(F.lit(0xFFFFFFFF)) - F.shiftright(x, 32))
    out = found.select(
        "k",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(items_sorted, ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        items_sorted.alias("items"),
        "hits",
    )
    return with_ids(out, docs, unique)


def brute_force(docs: list[tuple], items: list[tuple], width: int = WIDTH) -> dict:
    """What find_leaks() must return, by the definition; for tests."""
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))
    windows: dict = {}
    for i, t in items:
        w = split(t)
        n = min(width, len(w))
        for s in range(len(w) - n + 1 if n and i is not None else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    out = {}
    for k, t in docs:
        w = split(t)
        hit, who = set(), set()
        for window, holders in windows.items():
            for s in range(len(w) - len(window) + 1):
                if tuple(w[s : s + len(window)]) == window:
                    hit.update(range(s, s + len(window)))
                    who |= holders
        out[k] = (len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit))
    return out
