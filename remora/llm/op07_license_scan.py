"""License scans by diagonal voting.

All rolling k-gram hashes of a document's words are joined to the templates' positions. A match of
word p with template position t votes for the offset diagonal p - t; votes are summed by diagonal,
diagonals that lie within `gap` words of each other are merged (words were put in or left out), and
the template words that their votes cover, each counted once, must make up at least `least` of it.

Such a span is verified by aligning its words with the template's: those that match, in order, make up
at least `least` of the template and of the span; every telling word of the template (names, numbers)
is among them; and no modifier stands in the span that the template has not. Of spans that overlap, the
one with the most matching words stays. The templates are a parameter of at most MAX_GRAMS positions,
so they are sent to every task, and a document is settled where its text is.

The base scan finds the places of fixed phrases word by word.

A null text is empty; empty texts have no words and no labels. Repeated rows are rows of their own.
Other columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, arrow_schema, keyed, with_ids
from .kernel import ALNUM_SPLIT, Words, blocks, ragged
from .licences import MODIFIERS, PHRASES, TELLING, TEMPLATES

GRAM = 3
GAP = 8
LEAST = 0.8
MAX_GRAMS = 100_000


def word_hashes(texts: list[str]) -> list[Words]:
    return [Words(data, offsets, ALNUM_SPLIT, lower=True) for t in texts for _, _, data, offsets in blocks(pa.array([t]))]


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Matching (place in text, place in template) of the best local alignment; a skipped word costs half a match."""
    score = np.zeros((len(text) + 1, len(template) + 1))
    skips = np.arange(len(template) + 1) / 2
    wanted = np.array(template)
    for i, word in enumerate(text, 1):
        best = np.maximum(0, score[i - 1] - 0.5)
        best[1:] = np.maximum(best[1:], np.where(wanted == word, score[i - 1][:-1] + 1, 0))
        # skips along the template, from the best place before
        score[i] = np.maximum.accumulate(best + skips) - skips
    i, j = (int(x) for x in np.unravel_index(np.argmax(score), score.shape))
    pairs = []
    while score[i, j] > 0:
        if text[i - 1] == template[j - 1] and score[i, j] == score[i - 1, j - 1] + 1:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif score[i, j] == score[i - 1, j] - 0.5:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


class Template:
    def __init__(self, label: str, words: Words, telling: set[int], modifiers: set[int]):
        self.label = label
        self.words = words.hash.tolist()
        digits = {h for h, a, b in zip(self.words, words.start, words.end, strict=True) if words.data[a:b].tobytes().isdigit()}
        self.required = {h for h in self.words if h in telling or h in modifiers} | digits
        self.foreign = modifiers - set(self.words)

    def verified(self, text: list[int], at: int, least: float) -> list[tuple[int, int, int, int]]:
        """(matching words, words of the span, first, end) of the verified spans in a part of a document that starts at `at`."""
        need, out = least * len(self.words), []
        # by windows that hold several copies, so that long parts take time in proportion
        width, start = 4 * len(self.words), 0
        while len(text) - start >= need:
            part = text[start : start + width]
            last = start + width >= len(text)
            pairs = align(part, self.words)
            if len(pairs) < need:
                start = len(text) if last else start + width // 2
                continue
            first, end = pairs[0][0], pairs[-1][0] + 1
            out += self.verified(part[:first], at + start, least)
            if not last and first and end + len(self.words) > width:
                start += first  # it may go on behind the window
                continue
            same = {part[i] for i, _ in pairs}
            if len(pairs) >= least * (end - first) and self.required <= same and not self.foreign & set(part[first:end]):
                out.append((len(pairs), end - first, at + start + first, at + start + end))
            start += end
        return out


def verified_spans(words: list[int], p: np.ndarray, t: np.ndarray, tp: np.ndarray, templates: list[Template], gram: int, gap: int, least: float) -> list[tuple[int, int, str, float]]:
    """(first, end, label, share) of a document's spans, from the matches of its words p with positions tp of templates t."""
    diagonal = p - tp
    order = np.lexsort((diagonal, t))
    p, t, tp, diagonal = p[order], t[order], tp[order], diagonal[order]
    new = np.r_[True, (t[1:] != t[:-1]) | (diagonal[1:] - diagonal[:-1] > gap)]
    edges = np.append(np.flatnonzero(new), len(p))
    found: set[tuple] = set()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        template = templates[int(t[a])]
        covered = np.zeros(len(template.words), dtype=bool)
        for step in range(gram):
            covered[tp[a:b] + step] = True
        if covered.sum() < least * len(template.words):
            continue
        low, high = max(0, int(p[a:b].min()) - gap), int(p[a:b].max()) + gram + gap
        for same, size, first, end in template.verified(words[low:high], low, least):
            found.add((-same, size, template.label, first, end, same / len(template.words)))
    kept: list[tuple[int, int, str, float]] = []
    for _, _, label, first, end, share in sorted(found):
        at = bisect.bisect(kept, (first,))
        # those that are kept lie apart, so only the neighbours can overlap
        if (at == 0 or kept[at - 1][1] <= first) and (at == len(kept) or kept[at][0] >= end):
            kept.insert(at, (first, end, label, share))
    return kept


SPANS = "array<struct<low: int, end: int, label: string, share: double>>"
BASE = "k long, n_words long, n_base long, first_word long, last_word long, base array<string>, spans " + SPANS


def emit_base(phrases: dict[str, str], templates: list[Template], positions: np.ndarray, gram: int, gap: int, least: float):
    """positions has (hash, template, position) by hash."""
    schema = arrow_schema(BASE)
    ranked = np.ascontiguousarray(positions[:, 0])
    wanted = [(w.hash.copy(), label) for w, label in zip(word_hashes(list(phrases)), phrases.values(), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for _, j, data, offsets in blocks(batch.column(1)):
                words = Words(data, offsets, ALNUM_SPLIT, lower=True)
                n = len(words.start)
                places, labels = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for x, (phrase, _) in enumerate(wanted):
                    at = np.flatnonzero(words.hash[: max(0, n - len(phrase) + 1)] == phrase[0])
                    for step in range(1, len(phrase)):
                        at = at[words.hash[at + step] == phrase[step]]
                    at = at[words.doc[at] == words.doc[at + len(phrase) - 1]]
                    places.append(at)
                    labels.append(np.full(len(at), x))
                at, label = np.concatenate(places), np.concatenate(labels)
                found: dict[int, tuple] = {}
                for d in np.unique(words.doc[at]) if len(at) else []:
                    own = words.doc[at] == d
                    spots = words.at[at[own]]
                    found[int(d)] = (int(own.sum()), int(spots.min()), int(spots.max()), sorted({wanted[x][1] for x in label[own]}))
                first, h = words.grams(gram)
                h = h.view(np.int64)
                left, right = np.searchsorted(ranked, h, side="left"), np.searchsorted(ranked, h, side="right")
                hit, step = ragged(right - left)
                votes = positions[left[hit] + step]
                owner, place = words.doc[first[hit]], words.at[first[hit]]
                spans: dict[int, list] = {}
                cuts = np.unique(np.r_[0, np.flatnonzero(owner[1:] != owner[:-1]) + 1, len(owner)])
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    d = int(owner[a])
                    own = words.hash[words.first[d] : words.first[d + 1]].tolist()
                    spans[d] = verified_spans(own, place[a:b], votes[a:b, 1], votes[a:b, 2], templates, gram, gap, least)
                names = list(schema.field("spans").type.value_type.names)
                rows += [(int(c), *found.get(d, (0, None, None, [])), [dict(zip(names, x, strict=True)) for x in spans.get(d, [])] or None) for d, c in enumerate(words.count)]
            columns = [batch.column(0), *[pa.array(list(c), type=f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True)]] if rows else [pa.array([], type=f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def template_rows(templates: dict[str, list[str]], n: int) -> tuple[list[tuple[int, int, int]], list[tuple[str, Words]]]:
    """(hash, template, position) of all grams; (label, words) of the templates."""
    rows, names = [], []
    for label, texts in sorted(templates.items()):
        for words in word_hashes(texts):
            first, h = words.grams(n)
            rows += [(int(x), len(names), int(p)) for p, x in zip(first, h.view(np.int64), strict=True)]
            names.append((label, words))
    if len(rows) > MAX_GRAMS:
        raise ValueError(f"templates have {len(rows)} positions; {MAX_GRAMS} is the most that is sent to every task")
    return rows, names


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None, gram: int = GRAM, gap: int = GAP, least: float = LEAST) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    score is the largest share of a template that a verified span covers, and 1 where only phrases are found.
    """
    docs, unique = keyed(docs)
    plain = docs.select("_k", "text")
    telling, modifiers = ({int(h) for w in word_hashes(x) for h in w.hash} for x in (TELLING, MODIFIERS))
    rows, texts = template_rows(templates or TEMPLATES, gram)
    known = [Template(label, words, telling, modifiers) for label, words in texts]
    positions = np.array(sorted(rows), dtype=np.int64).reshape(-1, 3)
    out = arrow_map(plain, emit_base(phrases or PHRASES, known, positions, gram, gap, least), BASE)
    none = F.array().cast("array<string>")
    own, best = F.array_distinct(F.transform("spans", lambda x: x["label"])), F.array_max(F.transform("spans", lambda x: x["share"]))
    out = out.select(
        "k",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce(own, none))), ",").alias("labels"),
        F.coalesce(best, F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"),
        "spans",
    )
    return with_ids(out, docs, unique)
