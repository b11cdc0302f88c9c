"""Exact substring dedup by a depth-limited radix sort of suffixes.

Every suffix is ordered only through its first `depth` bytes, most significant digits first; suffixes
that still share a group at that depth are exactly the repeated windows. The passes:

1. The first digit of a window is its minimiser: the smallest of the hashes of its `gram`-byte strings.
   Neighbouring windows mostly share theirs, so a run of them travels as one row (digit, hash of the
   run's bytes, document, start and length); no text is shuffled. Digits that occur once are done.
2. Runs with equal digit and equal bytes, by all 64 bits of the bytes' hash beside the digit's 64, are
   settled at once: all but the first repeat it.
3. Runs that share the digit and differ elsewhere are sorted by their bytes, eight at a time; windows
   left alone by a digit drop out of the next pass. A digit that very many different runs share is
   first split by one more digit, the hash of the single window. Of equal windows of a batch the first
   alone is sorted and the others are marked as its repeats, so that a window's group has a row of each
   batch at most.

A batch keeps one row of equal runs before the shuffle, and marks the others as repeats there and then.

Documents are ordered by doc_id (null last; those that share one, by their texts' hashes). A null text
is empty. Empty texts and those under `depth` bytes lose nothing. Repeated rows are documents of their
own, so that all but the first are removed. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, arrow_schema, keyed, with_ids, written
from .kernel import Hasher, U, blocks, mix, ragged, signed, sliding_min

DEPTH = 100
GRAM = 20
#: A digit that more different runs share than this is split by the hash of the single window.
HOT_RUNS = 4096
#: Windows that one sort handles at once, unless a group has more.
SORT_WINDOWS = 150_000

RUNS = "g long, h long, k long, p long"
PIECES = "g long, k long, start int, body binary"
SPANS = "k long, start int, n int"


def runs_of(data: np.ndarray, offsets: np.ndarray, depth: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, start, windows, digit, hash of bytes) of runs of windows with one minimiser."""
    none = np.zeros(0, np.int64)
    if len(data) < depth:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    hasher = Hasher(data)
    grams = hasher.rolling(gram)
    mask = U((1 << int(len(data)).bit_length()) - 1)
    packed = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
    least = (sliding_min(packed, depth - gram + 1) & mask).astype(np.int64)
    new = np.ones(len(least), dtype=bool)
    new[1:] = least[1:] != least[:-1]
    edges = np.concatenate([offsets[:-1], np.maximum(offsets[1:] - depth + 1, offsets[:-1])])
    new[edges[edges < len(new)]] = True
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(least)))
    doc = np.searchsorted(offsets, start, side="right") - 1
    inside = start + depth <= offsets[doc + 1]
    start, count, doc = start[inside], count[inside], doc[inside]
    body = hasher.spans(start, start + count + depth - 1)
    return doc, start - offsets[doc], count, grams[least[start]], body


def emit_runs(depth: int, gram: int):
    schema = arrow_schema(RUNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            parts = []
            for i, _, data, offsets in blocks(batch.column(1)):
                doc, start, count, digit, body = runs_of(data, offsets, depth, gram)
                parts.append((keys[i + doc], start, count, digit, body))
            if not parts:
                continue
            k, start, count, digit, body = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(k, kind="stable")  # a document's runs stand in their order already
            k, start, count, digit, body = k[order], start[order], count[order], digit[order], body[order]
            both = digit ^ (body * U(3))
            order = np.argsort(both, kind="stable")
            again = np.zeros(len(k), dtype=bool)
            same = (both[order][1:] == both[order][:-1]) & (body[order][1:] == body[order][:-1])
            again[order[1:][same]] = True
            p = (start << 8) | count
            g = np.where(again, mix(k.view(np.uint64) * U(0x9E3779B97F4A7C15) + p.view(np.uint64)), digit)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(g)), pa.array(signed(body)), pa.array(k), pa.array(np.where(again, -p, p))],
                schema=schema,
            )

    return run


def cut_pieces(depth: int):
    """Bytes of the runs that a digit could not tell apart; single windows of the hot digits."""
    schema = arrow_schema(PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            texts = batch.column(1).cast(pa.large_binary())
            lists = batch.column(2)
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            p, g, hot = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            start, count = p >> 8, p & 255
            _, at, raw = texts.buffers()
            offsets = np.frombuffer(at, dtype=np.int64)[texts.offset :]
            whole = ~hot.astype(bool)
            each, step = ragged(np.where(whole, 0, count))
            row = np.concatenate([row[whole], row[each]])
            begin = np.concatenate([start[whole], start[each] + step])
            size = np.concatenate([count[whole], np.ones(len(each), np.int64)]) + depth - 1
            group = np.concatenate([g[whole], g[each]])
            is_window = np.arange(len(row)) >= whole.sum()
            for i in range(0, len(row), 1 << 16):
                part = slice(i, i + (1 << 16))
                line, place = ragged(size[part])
                source = np.frombuffer(raw, dtype=np.uint8)
                body = source[(offsets[row[part]] + begin[part])[line] + place]
                ends = np.concatenate([[0], np.cumsum(size[part])])
                seen = Hasher(body).spans(ends[:-1], ends[1:])
                key = np.where(is_window[part], signed(mix(group[part].view(np.uint64) ^ seen)), group[part])
                # a window that stands in this batch before: a row without bytes, of a group of its own
                k, b = keys[row[part]], begin[part]
                order = np.lexsort((b, k, key))
                again = np.zeros(len(key), dtype=bool)
                again[order[1:]] = (key[order][1:] == key[order][:-1]) & is_window[part][order][1:]
                if again.any():
                    body = body[~again[line]]
                    ends = np.concatenate([[0], np.cumsum(np.where(again, 0, size[part]))])
                    key = np.where(again, signed(mix(k.view(np.uint64) ^ mix(b.astype(np.uint64)))), key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(keys[row[part]]), pa.array(begin[part].astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(body)])],
                    schema=schema,
                )

    return run


def radix_groups(data: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int, digit: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(windows that are left, their groups) after sorting by all digits; windows start in data at `at`.

    Each pass orders the windows of a group by the next digit and drops those that stand alone.
    """
    live = np.arange(len(at))
    for d in range(0, depth, digit):
        d = max(0, min(d, depth - digit))
        value = np.zeros(len(live), np.uint64)
        for i in range(min(digit, depth)):
            value = (value << U(8)) | data[at[live] + d + i]
        order = np.lexsort((value, group))
        live, group, value = live[order], group[order], value[order]
        new = np.ones(len(live), dtype=bool)
        new[1:] = (group[1:] != group[:-1]) | (value[1:] != value[:-1])
        group = np.cumsum(new)
        last = np.append(new[1:], True)
        keep = ~(new & last)
        live, group = live[keep], group[keep]
        if not len(live):
            break
    return live, group


def repeats(group: np.ndarray, k: np.ndarray, start: np.ndarray) -> np.ndarray:
    """True for all but the first, by (document, start), of each group."""
    order = np.lexsort((start, k, group))
    out = np.ones(len(group), dtype=bool)
    first = np.ones(len(group), dtype=bool)
    first[1:] = group[order][1:] != group[order][:-1]
    out[order[first]] = False
    return out


def sort_windows(depth: int):
    schema = arrow_schema(SPANS)

    def settle(g: np.ndarray, k: np.ndarray, start: np.ndarray, body: list[np.ndarray], size: np.ndarray) -> pa.RecordBatch:
        data = np.concatenate(body)
        ends = np.cumsum(size)
        row, step = ragged(size - depth + 1)
        at = (ends - size)[row] + step
        window_k, window_start = k[row], start[row] + step
        live, group = radix_groups(data, at, g[row], depth)
        again = live[repeats(group, window_k[live], window_start[live])]
        again = again[np.lexsort((window_start[again], window_k[again]))]
        kk, ss = window_k[again], window_start[again]
        new = np.ones(len(kk), dtype=bool)
        new[1:] = (kk[1:] != kk[:-1]) | (ss[1:] != ss[:-1] + 1)
        first = np.flatnonzero(new)
        return pa.RecordBatch.from_arrays([pa.array(kk[first]), pa.array(ss[first].astype(np.int32)), pa.array(np.diff(np.append(first, len(kk))).astype(np.int32))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        waiting = 0  # windows in held

        def merged(parts: list[tuple]) -> tuple:
            return tuple(np.concatenate([x[i] for x in parts]) for i in range(3)) + ([x[3] for x in parts], np.concatenate([x[4] for x in parts]))

        for batch in batches:
            marked = pc.equal(pc.binary_length(batch.column(3)), 0)
            if pc.any(marked).as_py():
                told = batch.filter(marked)
                yield pa.RecordBatch.from_arrays([told.column(1), told.column(2), pa.array(np.ones(told.num_rows, np.int32))], schema=schema)
                batch = batch.filter(pc.invert(marked))
                if not batch.num_rows:
                    continue
            body = batch.column(3).cast(pa.large_binary())
            offsets = np.frombuffer(body.buffers()[1], dtype=np.int64)[body.offset : body.offset + len(body) + 1]
            data = np.frombuffer(body.buffers()[2], dtype=np.uint8)
            g, k, start = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            start = start.astype(np.int64)
            size = np.diff(offsets)
            # rows come sorted by group; cut where a group ends and enough windows stand before it
            done = np.cumsum(size - depth + 1)
            ends = np.flatnonzero(g[1:] != g[:-1]) + 1
            stand = done[ends - 1]
            i = 0
            while (at := int(np.searchsorted(stand, SORT_WINDOWS - waiting + (done[i - 1] if i else 0)))) < len(ends):
                j = int(ends[at])
                held.append((g[i:j], k[i:j], start[i:j], data[offsets[i] : offsets[j]], size[i:j]))
                yield settle(*merged(held))
                held, waiting, i = [], 0, j
            if i < len(g):
                held.append((g[i:], k[i:], start[i:], data[offsets[i] : offsets[-1]], size[i:]))
                waiting += int(done[-1] - (done[i - 1] if i else 0))
        if held:
            yield settle(*merged(held))

    return run


DIGEST = "k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def apply_spans(depth: int, with_text: bool):
    schema = arrow_schema(DIGEST + (", kept binary" if with_text else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            keys = batch.column(0).to_pylist()
            texts = batch.column(1).fill_null("").cast(pa.large_binary())
            spans = batch.column(2)
            for i, k in enumerate(keys):
                text = texts[i].as_buffer()
                if not spans[i].is_valid:
                    rows.append((k, text.size, 0, 0, hashlib.sha256(text).hexdigest(), text.to_pybytes() if with_text else None))
                    continue
                p = spans[i].values.to_numpy(zero_copy_only=False)
                edge = np.zeros(text.size + 1, dtype=np.int32)
                np.add.at(edge, p >> 32, 1)
                np.add.at(edge, (p >> 32) + (p & 0xFFFFFFFF) + depth - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
                n = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                rows.append((k, text.size, int(gone.sum()), n, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=False)], schema=schema)

    return run


def remove_repeats(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, hot_runs: int = HOT_RUNS, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row (and kept, the bytes left, if asked for)."""
    if not gram < depth <= 200:
        raise ValueError("depth must be above gram, and 200 at most")
    docs, unique = keyed(docs)
    plain = docs.select("_k", "text")
    runs = arrow_map(plain, emit_runs(depth, gram), RUNS).repartition("g")
    ordered = Window.partitionBy("g", "h").orderBy("k", "p")
    digit = Window.partitionBy("g")
    ranked = runs.select("g", "h", "k", "p", F.row_number().over(ordered).alias("rank"))
    ranked = ranked.select("*", F.min("h").over(digit).alias("low"), F.max("h").over(digit).alias("high"), F.count_if(F.col("rank") == 1).over(digit).alias("many"))
    again = (F.col("p") < 0) | (F.col("rank") > 1)
    settled = written(
        ranked.filter(again | (F.col("low") != F.col("high"))).select("k", F.abs("p").alias("p"), F.when(again, None).otherwise(F.col("g")).alias("g"), (F.col("many") > hot_runs).alias("hot")),
        "runs",
    )
    # both joins below read the same exchange of the texts by their key; an inner join asks for keys without nulls, so both do
    unsettled = settled.filter("g IS NOT NULL").groupBy("k").agg(F.collect_list(F.struct("p", "g", "hot")).alias("runs"))
    texts = plain.withColumnRenamed("_k", "id").filter("id IS NOT NULL")
    pieces = arrow_map(texts.join(unsettled, F.col("id") == F.col("k")).select("id", "text", "runs"), cut_pieces(depth), PIECES)
    sorted_out = arrow_map(pieces.repartition("g").sortWithinPartitions("g"), sort_windows(depth), SPANS)
    whole = settled.filter("g IS NULL").select("k", F.shiftright("p", 8).alias("start"), F.col("p").bitwiseAND(F.lit(255)).alias("n"))
    spans = whole.unionByName(sorted_out.select("k", F.col("start").cast("long"), F.col("n").cast("long")))
    spans = spans.groupBy("k").agg(F.collect_list(F.shiftleft("start", 32) + F.col("n")).alias("spans"))
    joined = texts.join(spans, F.col("id") == F.col("k"), "left").select("id", "text", "spans")
    out = arrow_map(joined, apply_spans(depth, with_text), DIGEST + (", kept binary" if with_text else ""))
    return with_ids(out, docs, unique)
