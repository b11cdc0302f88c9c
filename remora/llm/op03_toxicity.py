"""Toxicity by a support vector machine on a gapped subsequence string kernel, with Nystroem landmarks.

The kernel of two strings sums, over their subsequences of three and four bytes that span at most six
(and one shape of four that spans seven),
lambda to the power of both spans: "i.d.i.o.t" and "idixot" still share most of what they have with
"idiot". A string is a blank-separated token, lower-cased, with its ends marked and its outer
punctuation cut off; a character put between two letters, or a blank between single ones, is dropped,
and tokens of more than PIECE bytes are cut in overlapping pieces.

Landmarks are tokens of labelled sentences: those that set toxic documents apart, and the clean ones
most like them. A token's Nystroem features are its kernels with the landmarks, whitened. As only whole
documents are labelled, the machine chooses the tokens that make a sentence toxic itself: every token of
a clean sentence is clean; each toxic document has at least one toxic token, its best so far. A
document's margin is that of its worst sentence, and a sentence's that of its worst token; a logistic
curve turns margins into scores. The margin is linear in the kernel, so landmarks and weights fold into
one table of subsequence weights that is sent to the tasks.

Of the sample's clean tokens, the machine trains with those most like the toxic ones and the most common
(HARD of each, of the POOL most common), and each round adds the WORST that it has wrong; the kernel's
cells are hashed to 2 ** BITS. These bound the fit, not what is scored. Spellings with characters put in
(disguised()) are added for the landmarks' words.

Training reads a sample of at most SAMPLE_TOXIC and SAMPLE_CLEAN labelled documents (the first by hash
of doc_id), never those whose crc32(doc_id) mod 5 is 0; everything is scored.

Null and empty texts have the margin of nothing toxic. Labels that are null, or belong to no document,
are passed over; a document with several labels is toxic if one says so. Without labels of both kinds
every score is 0. Repeated rows are scored each; other columns are ignored, and scored() carries whole
rows, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, packed
from .kernel import BLANK_SPLIT, LOWER, Words, blocks

SAMPLE_TOXIC = 1500
SAMPLE_CLEAN = 6000
LANDMARKS = 160
ROUNDS = 3
#: Clean tokens that the fit compares with the landmarks, trains with from the start, and adds each round.
POOL, HARD, WORST = 20_000, 6000, 3000
LAMBDA = 0.6
BITS = 16
PIECE = 44
#: Places of a subsequence's letters after its first, and its span.
SHAPES = [(a, b) for b in range(2, 6) for a in range(1, b)] + [(a, b, c) for c in range(3, 6) for b in range(2, c) for a in range(1, b)] + [(2, 4, 6)]
_CODES = np.random.Generator(np.random.PCG64(7)).integers(0, 2**32, (4, 256), dtype=np.uint64).astype(np.uint32)
_ALNUM = np.ones(256, dtype=bool)
_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False


#: Blanks part words.
BLANK_BYTES = ~BLANK_SPLIT


class Tokens:
    """The distinct tokens of a block as a padded byte table, and where each stands."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = LOWER[data]
        letter = _ALNUM[data]
        if len(data) > 4:  # "i d i o t" and "i.d-iot" lose what was put between their letters
            drop = np.zeros(len(data), dtype=bool)
            drop[1:-1] = ~letter[1:-1] & letter[:-2] & letter[2:]
            lone = np.zeros(len(data), dtype=bool)
            lone[1:-1] = letter[1:-1] & ~letter[:-2] & ~letter[2:]
            lone[0], lone[-1] = letter[0] & ~letter[1], letter[-1] & ~letter[-2]
            between = np.zeros(len(data), dtype=bool)
            between[1:-1] = lone[:-2] & lone[2:]
            drop &= between | ~BLANK_BYTES[data]
            inner = offsets[1:-1]
            drop[inner[inner < len(data)]] = False
            drop[np.maximum(inner - 1, 0)] = False
            data = data[~drop]
            offsets = offsets - np.concatenate([[0], np.cumsum(drop)])[offsets]
            letter = _ALNUM[data]
        words = Words(data, offsets, BLANK_SPLIT)
        at = np.flatnonzero(letter)
        if not len(at):
            at = np.array([-1])
        low = np.searchsorted(at, words.start)
        high = np.searchsorted(at, words.end) - 1
        real = low <= high
        self.start, self.end, self.doc = at[low[real]], at[high[real]] + 1, words.doc[real]
        size = self.end - self.start
        long = np.flatnonzero(size > PIECE)
        if len(long):
            extra = [(s, min(s + PIECE, self.end[i]), self.doc[i]) for i in long for s in range(self.start[i] + PIECE // 2, self.end[i] - PIECE // 2, PIECE // 2)]
            self.end = np.minimum(self.end, self.start + PIECE)
            if extra:
                s, e, d = (np.array(x) for x in zip(*extra, strict=True))
                self.start, self.end, self.doc = np.r_[self.start, s], np.r_[self.end, e], np.r_[self.doc, d]
        self.data = data

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(rows of one of each, which of them each token is)."""
        from .kernel import Hasher

        if not len(self.start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        _, one, back = np.unique(Hasher(self.data).spans(self.start, self.end), return_index=True, return_inverse=True)
        return one, back

    def tables(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places in rows, bytes with marked ends, lengths), by classes of length."""
        size = self.end[rows] - self.start[rows] + 2
        low = 0
        for width in (8, 12, 20, PIECE + 2):
            own = np.flatnonzero((size > low) & (size <= width))
            low = width
            if not len(own):
                continue
            place = np.arange(width)[None, :]
            source = np.minimum(self.start[rows[own]][:, None] + place - 1, len(self.data) - 1)
            body = self.data[np.maximum(source, 0)]
            n = size[own][:, None]
            body = np.where(place >= n, 0, np.where(place == 0, 1, np.where(place == n - 1, 2, body))).astype(np.uint8)
            yield own, body, size[own]


def _shape(body: np.ndarray, size: np.ndarray, shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(cells, weights) of all subsequences of one shape."""
    span = shape[-1]
    m = max(0, body.shape[1] - span)
    code = _CODES[0][body[:, :m]] * np.uint32(1 if len(shape) == 2 else 3)
    for i, step in enumerate(shape):
        code = code + _CODES[i + 1][body[:, step : step + m]]
    weight = (np.arange(m)[None, :] + span < size[:, None]) * np.float32(LAMBDA ** (span + 1))
    return code >> np.uint32(32 - BITS), weight


def _norm(size: np.ndarray) -> np.ndarray:
    total = np.zeros(len(size))
    for shape in SHAPES:
        total += np.maximum(size - shape[-1], 0) * LAMBDA ** (2 * (shape[-1] + 1))
    return np.sqrt(np.maximum(total, 1e-9))


def margins(tokens: Tokens, rows: np.ndarray, table: np.ndarray) -> np.ndarray:
    """table's weight of each token."""
    out = np.zeros(len(rows))
    for own, body, size in tokens.tables(rows):
        total = np.zeros(len(own), dtype=np.float32)
        for shape in SHAPES:
            cell, weight = _shape(body, size, shape)
            total += (table[cell] * weight).sum(axis=1)
        out[own] = total / _norm(size)
    return out


def kernels(tokens: Tokens, rows: np.ndarray, landmarks: np.ndarray, step: int = 1000) -> np.ndarray:
    """Kernels with landmarks, given as cells x landmarks."""
    out = np.zeros((len(rows), landmarks.shape[1]), dtype=np.float32)
    for own, body, size in tokens.tables(rows):
        for i in range(0, len(own), step):
            part = slice(i, i + step)
            total = np.zeros((len(own[part]), landmarks.shape[1]), dtype=np.float32)
            for shape in SHAPES:
                cell, weight = _shape(body[part], size[part], shape)
                for j in range(cell.shape[1]):
                    total += landmarks[cell[:, j]] * weight[:, j : j + 1]
            out[own[part]] = total / _norm(size[part])[:, None]
    return out


def cells_of(tokens: Tokens, rows: np.ndarray) -> np.ndarray:
    """Normed subsequence weights: cells x rows."""
    out = np.zeros((1 << BITS, len(rows)), dtype=np.float32)
    for own, body, size in tokens.tables(rows):
        norm = _norm(size)
        for shape in SHAPES:
            cell, weight = _shape(body, size, shape)
            for j in range(cell.shape[1]):
                np.add.at(out, (cell[:, j], own), weight[:, j] / norm)
    return out


def data_of(tokens: Tokens, row: int) -> bytes:
    return tokens.data[tokens.start[row] : tokens.end[row]].tobytes()


def vocabulary(texts: list[str]) -> tuple[Tokens, np.ndarray]:
    """The distinct tokens of the texts, and document * their number + token for each that a document holds."""
    place: dict[bytes, int] = {}
    docs, ids = [], []
    for i, _, data, offsets in blocks(pa.array(texts)):
        tokens = Tokens(data, offsets)
        one, back = tokens.distinct()
        own = np.array([place.setdefault(data_of(tokens, r), len(place)) for r in one], dtype=np.int64)
        docs.append(tokens.doc + i)
        ids.append(own[back] if len(one) else np.zeros(0, np.int64))
    out = Tokens.__new__(Tokens)
    out.data = np.frombuffer(b" ".join(place) + b" ", dtype=np.uint8)
    size = np.array([len(t) for t in place], dtype=np.int64)
    out.start = np.cumsum(size + 1) - size - 1
    out.end, out.doc = out.start + size, np.zeros(len(size), np.int64)
    return out, np.unique(np.concatenate(docs) * max(1, len(place)) + np.concatenate(ids))


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Squared-hinge machine with a bias, by Newton steps on the rows inside the margin."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    base = ridge * np.eye(x.shape[1])
    for _ in range(30):
        inside = y * (x @ w) < 1
        xs = x[inside] * cost[inside, None]
        after = np.linalg.solve(base + xs.T @ x[inside], xs.T @ y[inside])
        if np.allclose(after, w, atol=1e-7):
            break
        w = after
    return w


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a lightly damped logistic curve."""
    a = np.c_[x, np.ones(len(x))]
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, a.T @ (p - t) + 1e-3 * w), -5, 5)
    return float(w[0]), float(w[1])


class Model:
    """Weights of subsequences, bias, and the logistic curve."""

    def __init__(self, table: np.ndarray | None, bias: float = 0.0, slope: float = 1.0, offset: float = 0.0):
        self.table, self.bias, self.slope, self.offset = table, bias, slope, offset

    def worst(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The highest margin of each document's tokens."""
        out = np.full(len(offsets) - 1, -1.0)
        tokens = Tokens(data, offsets)
        one, back = tokens.distinct()
        if len(one):
            value = margins(tokens, one, self.table)[back] + self.bias
            np.maximum.at(out, tokens.doc, value)
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.table is None:
            return np.zeros(len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.worst(data, offsets) + self.offset, -30, 30)))


def disguised(words: list[bytes]) -> list[bytes]:
    """Spellings with characters put in, of words long enough to be told apart."""
    out = []
    for w in words:
        if 4 <= len(w) <= 12 and w.isalpha():
            out += [b".".join(w[i : i + 1] for i in range(len(w)))]
            out += [w[:i] + x + w[i:] for i, x in ((2, b"-"), (len(w) // 2, b"."), (len(w) // 2, b"x"), (len(w) - 1, b"*"), (2, w[1:2]))]
    return sorted(set(out))


def train(texts: list[str], toxic: list[int], landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> Model:
    """Fits on labelled texts; deterministic. The curve is fitted with a third of the texts that the machine never saw."""
    y = np.array(toxic)
    seen = np.arange(len(y)) % 3 > 0
    if len(y) < 2 or not y[seen].any() or y[seen].all():
        return Model(None)
    all_y, y = y, y[seen]
    tokens, pair = vocabulary([t for t, own in zip(texts, seen, strict=True) if own])
    one = np.arange(len(tokens.start))
    doc, token = pair // max(1, len(one)), pair % max(1, len(one))
    if not len(one):
        return Model(None)
    in_toxic = np.bincount(token[y[doc] > 0], minlength=len(one))
    in_clean = np.bincount(token[y[doc] == 0], minlength=len(one))
    ratio = y.sum() / (len(y) - y.sum())
    apart = in_toxic - 3 * ratio * in_clean
    seeds = np.argsort(-apart, kind="stable")[: landmarks // 2]
    seeds = seeds[in_toxic[seeds] >= 2] if (in_toxic[seeds] >= 2).any() else seeds[:1]
    rest = np.argsort(-in_clean, kind="stable")
    rest = rest[in_clean[rest] > 0]
    like = np.zeros(len(one))
    near = kernels(tokens, one[rest[:POOL]], cells_of(tokens, one[seeds[:40]])).max(axis=1) if len(rest) else np.zeros(0)
    like[rest[:POOL]] = near
    hard = rest[:POOL][np.argsort(-near, kind="stable")]
    chosen = np.r_[seeds, hard[: landmarks // 4], rest[: landmarks // 4]]
    chosen = np.sort(np.unique(chosen))
    cells = cells_of(tokens, one[chosen])
    grid = kernels(tokens, one[chosen], cells).astype(np.float64)
    value, vector = np.linalg.eigh((grid + grid.T) / 2)
    good = value > 1e-6 * value.max()
    whiten = vector[:, good] / np.sqrt(value[good])
    wrong = np.unique(np.r_[hard[:HARD], rest[:HARD]])
    right = np.unique(np.r_[seeds, np.flatnonzero((in_toxic >= 3) & (in_clean == 0))])
    variants = disguised([data_of(tokens, one[i]) for i in seeds])
    extra = np.frombuffer(b" ".join(variants), dtype=np.uint8)
    more = Tokens(extra, np.array([0, len(extra)]))
    x_more = kernels(more, np.arange(len(more.start)), cells) @ whiten
    for _ in range(rounds):
        rows = np.r_[right, wrong]
        x = np.r_[kernels(tokens, one[rows], cells) @ whiten, x_more]
        target = np.r_[np.ones(len(right)), -np.ones(len(wrong)), np.ones(len(x_more))]
        cost = np.r_[np.r_[in_toxic[right].astype(float), in_clean[wrong].astype(float)] ** 0.5, np.ones(len(x_more))]
        w = svm(x, target, cost)
        model = Model((cells @ (whiten @ w[:-1])).astype(np.float32), float(w[-1]))
        g = margins(tokens, one, model.table) + model.bias
        # the best token of each toxic document, and all above the line; the clean tokens most in the wrong
        best = {}
        own = y[doc] > 0
        order = np.lexsort((token[own], -g[token[own]], doc[own]))
        d, t = doc[own][order], token[own][order]
        first = np.r_[True, d[1:] != d[:-1]]
        best = t[first]
        above = np.flatnonzero((g > 0) & (in_toxic > 0) & (in_clean == 0))
        right = np.unique(np.r_[best[in_clean[best] == 0], above]) if len(best) else right
        clean = np.flatnonzero(in_clean > 0)
        worst = clean[np.argsort(-g[clean], kind="stable")[:WORST]]
        wrong = np.unique(np.r_[wrong, worst])
        if not len(right):
            right = seeds
    worst_of = np.concatenate([model.worst(d, o) for _, _, d, o in blocks(pa.array(texts))])
    model.slope, model.offset = logistic(worst_of, all_y.astype(float))
    return model


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = SAMPLE_TOXIC, clean_rows: int = SAMPLE_CLEAN) -> Model:
    """The model of a bounded sample of labelled documents outside the fifth that is held out."""
    rows = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = rows.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).withColumn("at", F.md5(F.col("doc_id").cast("string")))
    parts = [rows.filter(F.col("toxic") == t).orderBy("at", "doc_id").limit(n) for t, n in ((1, toxic_rows), (0, clean_rows))]
    few = F.broadcast(parts[0].unionByName(parts[1]).select("doc_id", "toxic"))  # at most toxic_rows + clean_rows
    found = docs.select("doc_id", "text").join(few, "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").cast("int").alias("toxic"))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[0])
        m = train([t or "" for _, t, _ in rows], [y for _, _, y in rows])
        table = None if m.table is None else m.table.tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([table], type=pa.binary()), pa.array([m.bias]), pa.array([m.slope]), pa.array([m.offset])], names=["t", "bias", "slope", "offset"])

    # one task fits the bounded sample; the driver gets the finished table
    row = found.select("doc_id", "text", "toxic").coalesce(1).mapInArrow(fitted, "t binary, bias double, slope double, offset double").first()
    if row is None:  # no labelled document
        return Model(None)
    return Model(None if row["t"] is None else np.frombuffer(bytes(row["t"]), dtype=np.float32), row["bias"], row["slope"], row["offset"])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """_whole, the rows of docs, and score, a double. The text travels once, inside its row."""
    rows = packed(docs)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.struct_field(batch.column(0), [place])
            parts = [model.score(data, offsets) for _, _, data, offsets in blocks(texts)]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["_whole", "score"])

    return arrow_map(rows, run, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels)).select("_whole.doc_id", "score")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
