"""Near-duplicate documents by DartMinHash over word shingles.

A document is the set of its `shingle`-word shingles, each of weight 1 however often it stands, so that
signatures estimate the similarity that decides. Each whole unit of weight is a region into which hashed
darts fall, as a Poisson process along the rank axis: gaps between a region's darts are exponential and come from the
hash of (shingle, unit, dart), so that any two documents that share a region see the same darts there.
Darts up to the rank t / weight are thrown, t = k ln k + 2k; each dart names one of k coordinates, and
the earliest of each coordinate makes up the signature. Documents that leave a coordinate without a dart
throw on to twice the rank.

Signatures are cut in bands; documents that share a band are candidates. Pairs are dropped whose
signatures agree far too little, and the rest are verified by the exact Jaccard similarity of their
shingle sets. Equal texts are merged first, so a group of copies takes part once.

All pairs of a small bucket are compared at once. In a large one, ordered by the next band, a document
first meets the bucket's first, and in one of its large buckets also the next few, which joins most of what
belongs together. Then
whatever the verified pairs have left apart is compared: every pair of a large bucket whose ends are not
of one class yet, block by block. A pair within a class cannot change the classes, so they are
those that all pairs of all buckets would give.

A class is a connected component of verified pairs and equal texts. Texts of fewer words than a shingle
has are one shingle of all their words; texts without words match only equal texts. A null text counts
as empty. Repeated rows fall in one class. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, arrow_schema, keyed, packed, with_ids, written
from .graph import components
from .kernel import ALNUM_SPLIT, Hasher, U, Words, blocks, gram_hash, mix, ragged

K = 64
BAND = 4
SHINGLE = 5
SIMILARITY = 0.8
#: Pairs whose signatures agree in less than this share cannot reach SIMILARITY (over 4 standard deviations off).
LOOSE = 0.58
#: In a bucket's order, the first NEAR + 1 are paired with the next NEAR; those after them with the first of all, and in one bucket of theirs with the next FEW, before the rest is compared.
NEAR = 15
FEW = 4
#: Texts, and their shingles, of a block that large buckets are compared by, on average; columns of a block's matrix.
BLOCK = 256
SIZE = 500_000
COLUMNS = 8192

SIGNATURES = "k long, t1 long, t2 long, n long, sig binary"


def shingles(words: Words, n_docs: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of all shingles; a short text is one shingle."""
    first, h = words.grams(n)
    doc = words.doc[first]
    short = np.flatnonzero((words.count > 0) & (words.count < n))
    if len(short):
        own = [gram_hash(words.hash[words.first[d] : words.first[d + 1]], int(words.count[d]))[0] for d in short]
        doc, h = np.concatenate([doc, short]), np.concatenate([h, np.array(own, dtype=np.uint64)])
    return doc, h


def distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle) of the distinct shingles."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(doc) else np.zeros(0, np.int64)
    return doc[new], h[new]


def dart_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """n_docs x k uint32: the dart that comes first at each coordinate."""
    best = np.full(n_docs * k, np.inf)
    name = np.zeros(n_docs * k, dtype=np.uint64)
    total = np.bincount(doc, weight, minlength=n_docs)
    row, unit = ragged(weight)
    owner = doc[row]
    seed = mix(element[row] + U(0x9E3779B97F4A7C15) * (unit.astype(np.uint64) + U(1)))
    reach = (k * math.log(k) + 2 * k) / np.maximum(total, 1)
    rank = np.zeros(len(owner))
    dart = np.zeros(len(owner), dtype=np.uint64)
    live = np.arange(len(owner))
    waiting = total > 0
    while waiting.any():
        live = np.flatnonzero(waiting[owner]) if live is None else live
        while len(live):
            # the rank of a region's next dart
            x = mix(seed[live] ^ mix(dart[live] + U(0xA0761D6478BD642F)))
            gap = -np.log(((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53)
            inside = rank[live] + gap <= reach[owner[live]]
            live, x = live[inside], x[inside]
            rank[live] += gap[inside]
            dart[live] += U(1)
            y = mix(x ^ U(0xE7037ED1A0B428DB))
            cell = owner[live] * k + (y % U(k)).astype(np.int64)
            order = np.lexsort((y, rank[live], cell))
            cell, at, y = cell[order], rank[live][order], y[order]
            first = np.r_[True, cell[1:] != cell[:-1]] if len(cell) else np.zeros(0, bool)
            cell, at, y = cell[first], at[first], y[first]
            better = at < best[cell]
            best[cell[better]], name[cell[better]] = at[better], y[better]
        missing = np.isinf(best).reshape(n_docs, k).any(axis=1)
        waiting = waiting & missing
        reach = reach * 2
        live = None
    return (name >> U(32)).astype(np.uint32).reshape(n_docs, k)


def emit_signatures(k: int, n: int):
    schema = arrow_schema(SIGNATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, _, data, offsets in blocks(batch.column(1)):
                docs = len(offsets) - 1
                words = Words(data, offsets, ALNUM_SPLIT, lower=True)
                doc, h = distinct(*shingles(words, docs, n))
                sig = dart_minhash(doc, h, np.ones(len(doc), np.int64), docs, k)
                text = Hasher(data).spans(offsets[:-1], offsets[1:])
                # a second hash of the text, by its bytes in reverse
                other = Hasher(data[::-1]).spans(len(data) - offsets[1:], len(data) - offsets[:-1])
                parts.append((text.view(np.int64), other.view(np.int64), np.bincount(doc, minlength=docs), sig))
            if parts:
                t1, t2, size, sig = (np.concatenate(x) for x in zip(*parts, strict=True))
                body = pa.py_buffer(np.ascontiguousarray(sig))
                ends = pa.py_buffer((np.arange(len(t1) + 1) * 4 * k).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(t1), pa.array(t2), pa.array(size.astype(np.int64)), pa.Array.from_buffers(pa.binary(), len(t1), [None, ends, body])], schema=schema)

    return run


def agree(k: int, least: float):
    schema = arrow_schema("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint32).reshape(-1, k) for i in (2, 3))
            good = pa.array((one == two).mean(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], schema=schema)

    return run


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text."""
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for i, _, data, offsets in blocks(texts):
        doc, h = distinct(*shingles(Words(data, offsets, ALNUM_SPLIT, lower=True), len(offsets) - 1, n))
        rows.append(doc + i)
        found.append(h)
    return np.concatenate(rows), np.concatenate(found)


def similarities(one: pa.Array, two: pa.Array, n: int) -> np.ndarray:
    """The Jaccard similarity of each text of one block with each of another."""
    (d1, h1), (d2, h2) = shingle_sets(one, n), shingle_sets(two, n)
    shared = np.intersect1d(h1, h2)
    both = np.zeros((len(one), len(two)))
    for i in range(0, len(shared), COLUMNS):
        part = shared[i : i + COLUMNS]
        sides = []
        for d, h, rows in ((d1, h1, len(one)), (d2, h2, len(two))):
            at = np.minimum(np.searchsorted(part, h), len(part) - 1)
            hit = part[at] == h
            dense = np.zeros((rows, len(part)), dtype=np.float32)
            dense[d[hit], at[hit]] = 1
            sides.append(dense)
        both += sides[0] @ sides[1].T
    size1, size2 = np.bincount(d1, minlength=len(one)), np.bincount(d2, minlength=len(two))
    return both / np.maximum(1, size1[:, None] + size2[None, :] - both)


def jaccard_in_blocks(n: int, least: float):
    """The similar pairs, with ends in two classes, of two blocks of (key, class, text)."""
    schema = arrow_schema("a long, b long, similarity double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two in zip(batch.column(0), batch.column(1), strict=True):
                (k1, r1, t1), (k2, r2, t2) = ([block.values.field(i) for i in range(3)] for block in (one, two))
                found = similarities(t1, t2, n)
                x, y = np.nonzero((found >= least) & (r1.to_numpy()[:, None] != r2.to_numpy()[None, :]))
                a, b = k1.to_numpy()[x], k2.to_numpy()[y]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(found[x, y])], schema=schema)

    return run


def left_apart(plain: DataFrame, chosen: DataFrame, roots: DataFrame, bucket_of, shingle: int, similarity: float, near: int, block: int) -> DataFrame:
    """(a, b, similarity) of the similar pairs of large buckets whose ends are in two classes.

    The rows outside a bucket's largest class meet all of the bucket's. Both are dealt into blocks of a
    bounded size by the hash of their keys, so no bucket is gathered in one task, and only similar pairs
    become rows.
    """
    placed = chosen.join(roots, "k", "left").select("k", "n", "sig", F.coalesce("root", "k").alias("root"))
    rows = placed.select("k", "n", "root", F.explode(bucket_of).alias("x")).select("k", "n", "root", "x.bucket")
    shares = rows.groupBy("bucket", "root").agg(F.count("*").alias("rows"), F.sum("n").alias("size"))
    main = F.max(F.struct("rows", "root", "size"))
    mixed = shares.groupBy("bucket").agg(F.sum("rows").alias("rows"), F.sum("size").alias("size"), main.alias("main"))
    mixed = mixed.filter((F.col("rows") > near + 1) & (F.col("rows") > F.col("main.rows")))
    many = lambda rows, size: F.ceil(F.greatest(rows / block, size / SIZE))
    mixed = mixed.select("bucket", F.col("main.root").alias("main"), many(F.col("rows"), F.col("size")).alias("wide"), many(F.col("rows") - F.col("main.rows"), F.col("size") - F.col("main.size")).alias("high"))
    found = written(rows.join(mixed, "bucket").select("k", "root", "bucket", "main", "wide", "high"), "mixed")
    texts = plain.withColumnRenamed("_k", "k").join(found.select("k").distinct(), "k", "left_semi")
    found = found.join(texts, "k")
    of = lambda n: F.pmod(F.xxhash64("k"), F.col(n))
    gathered = F.collect_list(F.struct("k", "root", F.coalesce("text", F.lit("")).alias("text")))
    every = found.groupBy("bucket", of("wide").alias("at")).agg(gathered.alias("two"))
    others = found.filter("root <> main").groupBy("bucket", "wide", of("high").alias("own")).agg(gathered.alias("one"))
    others = others.select("bucket", "one", F.explode(F.sequence(F.lit(0).cast("long"), F.col("wide") - 1)).alias("at"))
    return arrow_map(others.join(every, ["bucket", "at"]).select("one", "two"), jaccard_in_blocks(shingle, similarity), "a long, b long, similarity double")


def jaccard(n: int, least: float):
    schema = arrow_schema("a long, b long, similarity double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for c in (2, 3):
                sets: list[np.ndarray] = []
                for _, _, data, offsets in blocks(batch.column(c)):
                    docs = len(offsets) - 1
                    doc, h = distinct(*shingles(Words(data, offsets, ALNUM_SPLIT, lower=True), docs, n))
                    edges = np.searchsorted(doc, np.arange(docs + 1))
                    sets += [h[edges[d] : edges[d + 1]] for d in range(docs)]
                sides.append(sets)
            found = np.zeros(batch.num_rows)
            for i, (x, y) in enumerate(zip(*sides, strict=True)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                found[i] = both / max(1, len(x) + len(y) - both)
            good = pa.array(found >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good), pa.array(found).filter(good)], schema=schema)

    return run


def candidates(chosen: DataFrame, bucket_of, near: int = NEAR, few: int = FEW) -> DataFrame:
    """(a, b): all pairs of small buckets; of large ones each row's with their firsts, and in one of them with the next few.

    A row that shares all its bands with a large group so has one pair a bucket and `few` more, and not `few` more in each.
    """
    buckets = chosen.select("k", F.explode(bucket_of).alias("x")).select("k", "x.*")
    order = Window.partitionBy("bucket").orderBy("next", "k")
    ahead = F.collect_list("k").over(order.rowsBetween(1, near))
    first = F.first("k").over(order.rowsBetween(Window.unboundedPreceding, 0))
    # each of the bucket's first rows meets all of them, so a small bucket has all its pairs
    place = F.row_number().over(order)
    rows = buckets.select("k", "bucket", (place > near + 1).alias("late"), ahead.alias("ahead"), first.alias("first")).filter("first <> k OR size(ahead) > 0")
    one = F.min(F.when(F.col("late") & (F.size("ahead") > 0), F.col("bucket"))).over(Window.partitionBy("k"))
    rows = rows.withColumn("one", one)
    ahead = F.when(~F.col("late"), F.col("ahead")).when(F.col("bucket") == F.col("one"), F.slice("ahead", 1, few)).otherwise(F.array().cast("array<bigint>"))
    pairs = rows.select("k", ahead.alias("ahead"), "first")
    pairs = pairs.select("k", F.explode(F.array_union("ahead", F.array("first"))).alias("o")).filter("k <> o")
    return pairs.select(F.least("k", "o").alias("a"), F.greatest("k", "o").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = K, band: int = BAND, shingle: int = SHINGLE, similarity: float = SIMILARITY, near: int = NEAR, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """(_k, rep, root) of each row of keyed docs: the first row of its text, and of its class."""
    plain = docs.select("_k", "text")
    signed = written(arrow_map(plain, emit_signatures(k, shingle), SIGNATURES), "signatures")
    firsts = signed.groupBy("t1", "t2").agg(F.min("k").alias("rep"))
    member = signed.select("k", "t1", "t2").join(firsts, ["t1", "t2"]).select("k", "rep")
    chosen = signed.filter("n > 0").join(member.filter("k = rep").select("k"), "k", "left_semi").select("k", "n", "sig")
    width, bands = 4 * band, k // band
    part = lambda i: F.xxhash64(F.lit(i % bands), F.substring("sig", (i % bands) * width + 1, width))
    bucket_of = F.array(*[F.struct(part(i).alias("bucket"), part(i + 1).alias("next")) for i in range(bands)])
    pairs = candidates(chosen, bucket_of, near, few)
    sig = lambda end, name: chosen.select(F.col("k").alias(end), F.col("sig").alias(name))
    close = arrow_map(pairs.join(sig("a", "sa"), "a").join(sig("b", "sb"), "b").select("a", "b", "sa", "sb"), agree(k, LOOSE * similarity / SIMILARITY), "a long, b long")
    texts = lambda end, name: plain.select(F.col("_k").alias(end), F.col("text").alias(name))
    edges = written(arrow_map(close.join(texts("a", "ta"), "a").join(texts("b", "tb"), "b").select("a", "b", "ta", "tb"), jaccard(shingle, similarity), "a long, b long, similarity double"), "pairs")
    roots = components(edges)
    more = written(left_apart(plain, chosen, roots, bucket_of, shingle, similarity, near, block), "apart")
    classes = member.join(roots.withColumnRenamed("k", "rep"), "rep", "left").select(F.col("k").alias("_k"), "rep", F.coalesce("root", "rep").alias("root"))
    if not more.limit(1).count():
        return classes
    # a graph of classes, which is far smaller than that of documents
    root_of = lambda end: roots.select(F.col("k").alias(end), F.col("root").alias(f"r{end}"))
    between = more.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    joined = components(written(between.distinct(), "between")).select(F.col("k").alias("root"), F.col("root").alias("low"))
    return classes.join(joined, "root", "left").select("_k", "rep", F.coalesce("low", "root").alias("root"))


def classify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, class_size and kept of each row.

    class_id is the doc_id of the class's first document, the one that stays.
    """
    docs, unique = keyed(docs)
    classes = near_duplicates(docs, **options)
    size = classes.groupBy("root").agg(F.count("*").alias("class_size"))
    out = classes.join(size, "root").select("_k", F.col("root").alias("class_id"), "class_size", (F.col("_k") == F.col("root")).alias("kept"))
    if unique:
        return out.withColumnRenamed("_k", "doc_id")
    names = docs.select(F.col("_k").alias("class_id"), F.col("doc_id").cast("long").alias("name"))
    out = out.join(names, "class_id").drop("class_id").withColumnRenamed("name", "class_id")
    return with_ids(out, docs, unique, "_k").select("doc_id", "class_id", "class_size", "kept")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The first document of each class, with the columns of docs."""
    keys, _ = keyed(packed(docs, "doc_id", "text"), "_whole")
    classes = near_duplicates(keys, **options)
    return keys.join(classes.filter("_k = root").select("_k"), "_k", "left_semi").select("_whole.*")
