"""Each operator against a brute-force version on small tables."""

import hashlib
import random
import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from remora.llm import op01_suffix_dedup as op1
from remora.llm import op02_passages as op2
from remora.llm import op03_toxicity as op3
from remora.llm import op04_quality as op4
from remora.llm import op05_fertility as op5
from remora.llm import op06_near_dedup as op6
from remora.llm import op07_license_scan as op7
from remora.llm import op08_shards as op8
from remora.llm import op09_mixing as op9
from remora.llm import op10_decontaminate as op10
from remora.llm import graph

DOCS = "doc_id long, text string, lang string, source string"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def made(seed, n=120, size=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    paragraphs = [" ".join(rng.choice(vocabulary) for _ in range(70)) for _ in range(5)]
    out = []
    for i in range(n):
        parts = [rng.choice([rng.choice(vocabulary)] * 12 + [rng.choice(paragraphs)]) for _ in range(rng.randint(0, size))]
        out.append((i, " ".join(parts), rng.choice(["en", "fr", None]), rng.choice(["a", "b", None])))
    out += [(n, None, None, None), (n + 1, "", "en", "a"), (n + 2, "a" * 400, "en", "a"), (n + 3, "a" * 300, "en", "b"), (n + 4, out[3][1], "en", "b")]
    changed = out[5][1].split(" ")
    out += [(n + 5, " ".join(["new", *changed[1:]]), "en", "b"), (n + 6, "one two", "en", "b"), (n + 7, "one two", "en", "b")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = made(1)
    return rows, spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("hot", [4096, 2])
def test_op1_equals_brute_force(docs, hot):
    rows, df = docs
    seen, want = set(), {}
    for k, t, *_ in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = [True] * 100
            seen.add(w)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        want[k] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    got = {r[0]: tuple(r[1:]) for r in op1.remove_repeats(df, hot_runs=hot).collect()}
    assert got == want


def test_op1_radix_groups_are_the_equal_windows():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    at = np.arange(380)
    live, group = op1.radix_groups(data, at, np.zeros(380, np.int64), 12)
    want = Counter(data[i : i + 12].tobytes() for i in at)
    assert {int(i) for i in live} == {i for i in at if want[data[i : i + 12].tobytes()] > 1}
    by = {}
    for i, g in zip(live, group, strict=True):
        by.setdefault(g, set()).add(data[i : i + 12].tobytes())
    assert all(len(x) == 1 for x in by.values()) and len(by) == sum(n > 1 for n in want.values())


def test_op1_keeps_runs_apart_whose_hashes_share_their_upper_half(monkeypatch):
    body = np.array([(1 << 32) + 1, (1 << 32) + 2, (1 << 32) + 1], dtype=np.uint64)
    monkeypatch.setattr(op1, "runs_of", lambda *_: (np.arange(3), np.zeros(3, np.int64), np.full(3, 5), np.full(3, 7, np.uint64), body))
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2]), pa.array(["a", "b", "c"])], names=["_k", "text"])
    rows = pa.Table.from_batches(op1.emit_runs(100, 20)([batch])).to_pylist()
    first = {r["k"]: (r["g"], r["h"]) for r in rows if r["p"] > 0}
    assert set(first) == {0, 1} and first[0] != first[1]


def single_windows(n, size, rng):
    """Batches of pieces of one window each, in the order of their groups; a twelfth of the windows stand twice."""
    bodies = [bytes(rng.randrange(97, 123) for _ in range(100)) for _ in range(n)]
    rows = sorted([(i, i, 0, b) for i, b in enumerate(bodies)] + [(i, n + i, 5, bodies[i]) for i in range(0, n, 12)])
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    columns = [pa.array(c, type=kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["g", "k", "start", "body"]), [slice(i, i + size) for i in range(0, len(rows), size)]


def test_op1_looks_for_a_place_to_cut_once_a_batch(spark, monkeypatch):
    n, size = 12_000, 500
    run = op1.sort_windows(100)
    whole, parts = single_windows(n, size, random.Random(3))
    batches = [whole.slice(p.start, size) for p in parts]
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    for most in (150_000, 700):
        monkeypatch.setattr(op1, "SORT_WINDOWS", most)
        calls = 0
        sys.setprofile(count)
        try:
            out = list(run(iter(batches)))
        finally:
            sys.setprofile(None)
        got = sorted((r["k"], r["start"], r["n"]) for b in out for r in b.to_pylist())
        assert got == [(n + i, 5, 1) for i in range(0, n, 12)]
        assert len(out) == 1 if most > n + n // 12 else len(out) > 10
        assert calls < n, calls


def test_op1_splits_a_digit_by_its_different_runs_not_by_its_copies(spark, monkeypatch):
    rng = random.Random(4)
    a = "".join(rng.choice("abcdefgh ") for _ in range(300))
    other = a[:150] + "#" + a[151:]
    kept = []
    monkeypatch.setattr(op1, "written", lambda df, name: kept.append(df.cache()) or kept[-1])
    df = spark.createDataFrame([(i, a) for i in range(8)] + [(8, other)], "doc_id long, text string").repartition(9, "doc_id")
    assert op1.remove_repeats(df, hot_runs=4).count() == 9
    found = kept[0].filter("g IS NOT NULL").collect()
    assert found and not any(r.hot for r in found)


def test_op1_deals_its_texts_out_once(spark):
    rng = random.Random(5)
    text = ["".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(4)]
    df = spark.createDataFrame([(i, text[i % 4][i:]) for i in range(40)], "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = op1.remove_repeats(df)
        assert len(out.collect()) == 40
        assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_op2_finds_every_repeated_run_of_50_words(docs):
    rows, df = docs
    seen, want = {}, set()
    for k, t, *_ in rows:
        w = words(t)
        mine = {tuple(w[i : i + 50]) for i in range(len(w) - 49)}
        if any(m in seen for m in mine):
            want.add(k)
        for m in mine:
            seen.setdefault(m, k)
    got = op2.repeated_passages(df).collect()
    assert want <= {r.doc_id for r in got}
    text = {k: words(t) for k, t, *_ in rows}
    for r in got:  # what is returned is similar, by definition
        a, b = (text[i][x : y + 1] for i, x, y in ((r.doc_id, r.first_word, r.last_word), (r.other_id, r.other_first, r.other_last)))
        x, y = ({tuple(s[i : i + 5]) for i in range(len(s) - 4)} for s in (a, b))
        assert len(x & y) / len(x | y) >= 0.8 and r.other_id < r.doc_id


def test_op2_finds_a_variant_that_two_documents_apart_share(spark):
    rng = random.Random(12)
    rows, want = [], set()
    for group in range(12):
        notice = [f"n{group}x{j}" for j in range(50)]
        variant = list(notice)
        variant[15], variant[33] = f"v{group}a", f"v{group}b"
        for i in range(9):
            own = [f"o{rng.randrange(10**9)}" for _ in range(120)]
            rows.append((group * 9 + i, " ".join([*own[:60], *(variant if i in (2, 8) else notice), *own[60:]])))
        want.add((group * 9 + 8, group * 9 + 2))
    got = op2.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert want <= {(r.doc_id, r.other_id) for r in got}
    assert {r.doc_id % 9 for r in got} == {1, 3, 4, 5, 6, 7, 8}  # the first notice and the first variant are no repeats
    assert len({(r.doc_id, r.other_id) for r in got}) == len(got)


def test_op2_nearest_smaller():
    rng = random.Random(2)
    value = np.array(rng.sample(range(1000), 60), dtype=np.uint64)
    group = np.repeat([0, 1, 2], 20)
    want = [max((j for j in range(i) if group[j] == group[i] and value[j] < value[i]), default=-1) for i in range(60)]
    assert op2.nearest_smaller(value, group).tolist() == want


def test_op3_kernel_is_the_gapped_subsequence_kernel():
    a = op3.vocabulary(["idiot", "idxiot", "window"])[0]
    n = np.array(sorted(range(3), key=lambda i: op3.data_of(a, i)))
    k = op3.kernels(a, n, op3.cells_of(a, n))
    assert np.allclose(k, k.T, atol=1e-5) and k[0, 1] > 3 * k[0, 2]

    def by_definition(x, y):
        x, y = b"\x01" + x + b"\x02", b"\x01" + y + b"\x02"

        def parts(w):
            out = Counter()
            for shape in op3.SHAPES:
                for i in range(len(w) - shape[-1]):
                    out[len(shape), bytes(w[i + s] for s in (0, *shape))] += op3.LAMBDA ** (shape[-1] + 1)
            return out

        p, q = parts(x), parts(y)
        return sum(v * q[s] for s, v in p.items()) / (op3._norm(np.array([len(x)]))[0] * op3._norm(np.array([len(y)]))[0])

    assert abs(k[0, 1] - by_definition(b"idiot", b"idxiot")) < 0.01


def test_op3_learns_and_tolerates_inserted_characters(spark):
    import zlib

    rng = random.Random(4)
    clean = ["the", "river", "was", "calm", "over", "stone", "field", "house", "green", "light", "closer", "lower"]
    bad = ["stupid", "worthless", "pathetic"]
    rows, labels = [], []
    for i in range(600):
        toxic = int(rng.random() < 0.3)
        t = [rng.choice(clean) for _ in range(rng.randint(5, 60))]
        if toxic:
            t.insert(rng.randrange(len(t)), rng.choice(bad))
        rows.append((i, " ".join(t)))
        labels.append((i, toxic))
    rows += [(1000, "the s.t.u.p.i.d river"), (1001, "a stupiid house"), (1002, None), (1003, ""), (1004, "the p a t h e t i c field")]
    labels += [(None, 1), (1, None), (9999, 1)]
    got = {r.doc_id: r for r in op3.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [i for i, _ in enumerate(rows[:600]) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in range(600) if got[i].held_out} == set(held)
    assert np.mean([got[i].predicted == labels[i][1] for i in held]) >= 0.95
    assert got[1000].predicted == got[1001].predicted == got[1004].predicted == 1
    assert got[1002].predicted == got[1003].predicted == 0


def test_op3_and_op4_without_labels(spark, docs):
    _, df = docs
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert {r.score for r in op3.score_toxicity(df, none).collect()} == {0.0}
    assert df.count() == op4.rate_quality(df, none).count()


def test_op4_shrinks_sparse_sites(spark):
    rows = [(i, "big", "x", 3.0 if i % 10 else -3.0) for i in range(200)] + [(900, "tiny", "x", -3.0), (901, None, None, 3.0)]
    out = {r.doc_id: r for r in op4.posterior(spark.createDataFrame(rows, "doc_id long, host string, path string, odds double")).collect()}
    assert out[900].host_rate > 0.05  # one bad document does not condemn a site
    assert abs(out[0].host_rate - 0.86) < 0.05 and len(out) == len(rows)


def test_op4_learns(spark):
    rng = random.Random(5)
    good = [(i, " ".join(rng.choice(["wind", "sea", "road", "hill"]) + str(rng.random())[:3] for _ in range(80)), "en", "a") for i in range(100)]
    bad = [(100 + i, " ".join("BUY NOW!!" for _ in range(40)), "en", "b") for i in range(100)]
    labels = [(i, 1) for i in range(0, 100, 2)] + [(100 + i, 0) for i in range(0, 100, 2)]
    got = {r.doc_id: r.kept for r in op4.rate_quality(spark.createDataFrame(good + bad, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert all(got[i] for i in range(100)) and not any(got[100 + i] for i in range(100))


def test_op5_counts_equal_brute_force(spark):
    rows = made(6, 60) + [(500, "x y\n\nx y\nz |||\nx y", "en", "a"), (501, " a\tb\x0bc " * 30, None, None), (502, "日本語 テキスト " * 40, None, None)]
    got = {r.doc_id: r for r in op5.rate_fertility(spark.createDataFrame(rows, DOCS)).collect()}
    for k, t, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        count = Counter(zip(w, w[1:], w[2:], strict=False))
        inside = {j for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        seen, again = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                again += line in seen
                seen.add(line)
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), again, len(inside)), k
        assert r.base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_op5_rejects_bytes(spark):
    rng = random.Random(7)
    plain = [(i, " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(90)), "en", "a") for i in range(150)]
    junk = [(999, " ".join("".join(chr(rng.randint(0xA000, 0xA3FF)) for _ in range(5)) for _ in range(90)), "en", "a")]
    got = {r.doc_id: r for r in op5.rate_fertility(spark.createDataFrame(plain + junk, DOCS)).collect()}
    assert not got[999].kept and not got[999].base_failed and got[999].byte_share > 0.5
    assert sum(got[i].kept for i in range(150)) >= 148


def similar(a, b):
    return len(a & b) / max(1, len(a | b)) >= 0.8


def test_op6_classes_equal_brute_force(docs):
    rows, df = docs
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for k, w in ((k, words(t)) for k, t, *_ in rows)}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    text = {k: t or "" for k, t, *_ in rows}
    for a in sets:
        for b in sets:
            if a < b and (text[a] == text[b] or similar(sets[a], sets[b])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: r.class_id for r in op6.classify(df).collect()}
    assert got == {k: find(k) for k in sets}


def test_op6_darts_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    element = rng.integers(0, 2**63, 300, dtype=np.uint64)
    a, b = np.ones(300, np.int64), np.ones(300, np.int64)
    a[:40], b[260:] = 3, 2
    b[:30] = 0
    doc = np.repeat([0, 1], 300)
    w = np.r_[a, b]
    keep = w > 0
    sig = op6.dart_minhash(doc[keep], np.r_[element, element][keep], w[keep], 2, 2048)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.05


def test_op6_large_bucket(spark):
    rng = random.Random(8)
    base = [str(rng.random())[2:8] for _ in range(200)]
    rows = []
    for i in range(150):
        t = list(base)
        t[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(t)))
    got = {r.class_id for r in op6.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0}


def test_op6_large_buckets_equal_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for group in range(3):
        base = [f"w{group}x{rng.randrange(10**6)}" for _ in range(100)]
        for i in range(50):
            t = list(base)
            for _ in range(rng.choice([1, 2, 2, 3, 4])):
                t[rng.randrange(100)] = f"r{group}y{rng.randrange(25)}"
            rows.append((group * 50 + i, " ".join(t)))
    rng.shuffle(rows)
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in ((k, t.split()) for k, t in rows)}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and similar(sets[a], sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in op6.classify(df, band=1, near=1, few=0, block=8).collect()}
    assert 3 < len(set(got.values())) < 150
    assert got == {k: find(k) for k in sets}


def test_op6_rows_of_a_large_group_have_few_candidates(spark):
    """A group that shares all its bands: one pair a band and FEW more for each row, and one class in the end."""
    rng = random.Random(6)
    base = [str(rng.random())[2:8] for _ in range(800)]
    rows = []
    for i in range(600):
        t = list(base)
        t[rng.randrange(800)] = f"x{i}"
        rows.append((i, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    signed = op6.arrow_map(docs, op6.emit_signatures(op6.K, op6.SHINGLE), op6.SIGNATURES)
    part = lambda i: F.xxhash64(F.lit(i % 16), F.substring("sig", (i % 16) * 16 + 1, 16))
    buckets = F.array(*[F.struct(part(i).alias("bucket"), part(i + 1).alias("next")) for i in range(16)])
    small = (op6.NEAR + 1) * (op6.NEAR + 1)
    assert op6.candidates(signed.select("k", "sig"), buckets).count() <= 600 * (16 + op6.FEW) + 16 * small
    assert {r.class_id for r in op6.classify(docs).collect()} == {0}


def test_op6_repeats_inside_a_text_do_not_part_it_from_its_set(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for i in range(0, 60, 3):
        base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))
        line = " ".join(base.split(" ")[:9])
        # pasted twice, pasted four times, and with one line repeated many times
        rows += [(i, base), (i + 1, " ".join([base] * rng.choice([2, 4]))), (i + 2, " ".join([base] + [line] * 300))]
        want.update({i + j: i for j in range(3)})
    sets = {k: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for k, w in ((k, t.split(" ")) for k, t in rows)}
    assert all(similar(sets[a], sets[b]) for a, b in want.items())
    got = {r.doc_id: r.class_id for r in op6.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = dict(graph.components(edges).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_op7_base_and_templates(spark):
    mit = op7.TEMPLATES["mit-text"][1]
    cut = mit.split(" ")
    rows = [
        (1, "Released under the MIT License. Apache License, Version 2.0 and CC BY"),
        (2, mit),
        (3, " ".join([*cut[:30], "in", "short", *cut[30:]])),
        (4, " ".join(cut[:15])),
        (5, None),
        (6, "gnu general  public\nLICENSE mit licenses"),
    ]
    got = {r.doc_id: r for r in op7.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (3, 3, 11, "apache,cc-by,mit")
    assert got[2].labels == "mit-text" and got[2].score == 1.0
    assert got[3].labels == "mit-text" and 0.9 < got[3].score <= 1.0  # neighbouring diagonals are merged
    assert got[4].labels == "" and got[4].score == 0.0
    assert (got[5].n_words, got[5].n_base, got[5].first_word) == (0, 0, None)
    assert (got[6].n_base, got[6].labels) == (1, "gpl")


def test_op7_verifies_the_words_that_tell_licences_apart(spark):
    cc = "This work is licensed under the Creative Commons Attribution%s 4.0 International License."
    gpl, bsd = op7.TEMPLATES["gpl-3.0"][1], op7.TEMPLATES["bsd-3-clause"][0]
    texts = {
        cc % "": "cc-by-4.0",
        cc % "-NonCommercial": "cc-by-nc-4.0",
        cc % "-ShareAlike": "cc-by-sa-4.0",
        cc % "-NonCommercial-NoDerivatives": "",
        (cc % "").replace("4.0", "3.0"): "",
        "x " * 20 + cc % "-NonCommercial" + " and the data: " + cc % "": "cc-by-4.0,cc-by-nc-4.0",
        gpl: "gpl,gpl-3.0",
        gpl.replace("either version 3", "either version 2"): "gpl",
        bsd: "bsd-3-clause",
        bsd[: bsd.index("Neither")]: "",
    }
    got = {r.doc_id: r.labels for r in op7.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(texts.values()))


@pytest.mark.parametrize("shards", [24, 3])
def test_op8_laws(docs, shards):
    rows, df = docs
    got = op8.assign_shards(df.union(df), shards=shards).collect()
    assert len(got) == 2 * len(rows)
    size = {k: len((t or "").encode()) + 8 for k, t, *_ in rows}
    text = {k: t for k, t, *_ in rows}
    home, slots, load = {}, {}, Counter()
    for r in got:
        assert r.size == size[r.doc_id] and r.law == "bytes" and r.grown_shard is None
        assert home.setdefault(text[r.doc_id], r.shard) == r.shard
        slots.setdefault(r.shard, []).append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    largest = max(Counter(t for _, t, *_ in rows for _ in (0, 1))[t] * size[k] for k, t, *_ in rows)
    assert max(load.values()) - min(load[i] for i in range(shards)) <= largest


def test_op8_lpt_is_the_heap_rule():
    units = [(7, "a"), (6, "b"), (5, "c"), (4, "d"), (3, "e")]
    assert op8.lpt(units, 2) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 0}


def test_op9_targets_and_limits(spark):
    rng = random.Random(9)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 30))), "en", rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)]
    got = op9.mix_sources(spark.createDataFrame(rows, DOCS)).collect()
    text = {k: (len((t or "").split()), s) for k, t, _, s in rows}
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        n, s = text[r.doc_id]
        assert r.size == n and r.taken in (0, n, 2 * n)
        size[s] += n
        taken[s] += r.taken
        target[s] = r.target
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    for s in size:
        assert target[s] <= 2 * size[s] + 1e-9 and abs(taken[s] - target[s]) <= 60
    again = op9.mix_sources(spark.createDataFrame(rows[::-1], DOCS)).collect()
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in again}


def test_op10_equals_brute_force(spark):
    rng = random.Random(1)
    voc = "a b cc d É x1".split()
    docs = [(i, " ".join(rng.choice(voc) for _ in range(rng.randint(0, 60)))) for i in range(150)] + [(200, None), (201, ""), (202, "... !!")]
    items = [(i, " ".join(rng.choice(voc) for _ in range(rng.choice([0, 1, 3, 4, 5, 9, 10, 12])))) for i in range(12)]
    items += [(5, "cc d cc"), (None, "a"), (77, None), (78, "")] + [(90, d[1][5:45]) for d in docs[:10]]
    want = op10.brute_force(docs, items)
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for most in (200_000, 20):
        got = {r[0]: tuple(r[1:]) for r in op10.find_leaks(a, b, block_windows=most).drop("items", "hits").collect()}
        assert got == want


def test_op2_single_windows_are_compared_as_by_definition():
    rng = np.random.default_rng(5)
    for _ in range(30):
        width = 12
        theirs = rng.integers(0, 30, 60).astype(np.uint64)
        own = np.concatenate([rng.integers(0, 60, 10), theirs[20:40], rng.integers(0, 60, 15)]).astype(np.uint64)
        order = np.argsort(theirs, kind="stable")
        ranked = theirs[order]
        at = np.minimum(np.searchsorted(ranked, own), len(ranked) - 1)
        match = ranked[at] == own
        starts = np.array([s for s in range(len(own) - width + 1) if match[s : s + width].any()])
        rows = op2.single_windows(own, theirs, ranked, order, at, match, starts, width, step=7)
        for i, s in enumerate(starts):
            inside = np.flatnonzero(match[s : s + width]) + s
            x, y = int(inside[0]), int(inside[-1]) + 1
            middle = int(np.median(order[at[inside]] - inside))
            a, b = max(0, x + middle), min(len(theirs), y + middle)
            p, q = set(own[x:y].tolist()), set(theirs[a:b].tolist())
            assert (rows[0][i], rows[1][i], rows[2][i], rows[3][i]) == (x, y, a, b)
            assert abs(rows[4][i] - len(p & q) / max(1, len(p | q))) < 1e-12


def alike_runs(one: list[str], two: list[str]) -> bool:
    """Whether two texts have runs of 50 words whose five-word shingles have a Jaccard similarity of 0.8, by definition."""
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (one, two)]
    if len(grams[0] & grams[1]) < 20:
        return False
    runs = [[{tuple(w[i + j : i + j + 5]) for j in range(46)} for i in range(len(w) - 49)] for w in (one, two)]
    runs = [[x for x in side if len(x & other) >= 0.8 * len(x)] for side, other in zip(runs, reversed(grams), strict=True)]
    return any(len(x & y) / len(x | y) >= 0.8 for x in runs[0] for y in runs[1])


def changed(rng, words: list[str], edits: int) -> list[str]:
    words = list(words)
    for _ in range(edits):
        place, new = rng.randrange(len(words)), f"e{rng.randrange(10**9)}"
        rng.choice([lambda: words.__setitem__(place, new), lambda: words.insert(place, new), lambda: words.pop(place)])()
    return words


@pytest.mark.parametrize("few", [op2.FEW, 1])
def test_op2_classes_are_those_of_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(op2, "FEW", few)
    monkeypatch.setattr(op2, "COMPARED", op2.COMPARED if few > 1 else 0)
    rng = random.Random(21)
    notices = [[f"n{g}x{j}" for j in range(n)] for g, n in enumerate((52, 60, 75, 30, 44))]
    texts = []
    for _ in range(70):
        parts = [[f"o{rng.randrange(10**9)}" for _ in range(rng.randrange(5, 30))]]
        for notice in rng.sample(notices, rng.randrange(1, 3)):
            parts += [changed(rng, notice, rng.randrange(4)), [f"o{rng.randrange(10**9)}" for _ in range(rng.randrange(5, 30))]]
        texts.append([w for p in parts for w in p])
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and alike_runs(texts[i], texts[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    got = op2.passage_classes(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == dict(enumerate(root)) and 1 < len(set(root)) < len(root)
    assert {r.doc_id: r.class_size for r in got} == {i: root.count(r) for i, r in enumerate(root)}


def test_op2_links_two_passages_that_only_a_variant_of_a_verified_one_joins(spark):
    # 0 and 1 are not alike, 2 is like both: its passage is verified with 0 and must still meet 1
    notice = [f"n{j}" for j in range(60)]
    rows = []
    for i, places in enumerate([(10, 47), (25, 40), (25, 47)] * 4):
        words = list(notice)
        for p in places:
            words[p] = f"v{p}"
        rows.append((i, " ".join([*[f"a{i}x{j}" for j in range(30)], *words, *[f"b{i}x{j}" for j in range(30)]])))
    texts = [t.split() for _, t in rows]
    assert not alike_runs(texts[0], texts[1])
    want = {(i, j) for i in range(12) for j in range(i) if alike_runs(texts[i], texts[j])}
    got = op2.passage_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    root = {r.doc_id: r.class_id for r in got}
    assert len(got) == 12 and all(root[i] == root[j] for i, j in want)


@pytest.mark.parametrize("compared", [op2.COMPARED, 0])
def test_op2_keys_join_what_all_pairs_join(monkeypatch, compared):
    monkeypatch.setattr(op2, "COMPARED", compared)
    rng = np.random.default_rng(3)
    rule = op2.Break(50, 5, 0.8)
    for _ in range(5):
        base, sides = rng.integers(0, 2**31, (3, 200)), []
        for _ in range(90):
            w = base[rng.integers(3)].tolist()
            for _ in range(rng.integers(4)):
                p, v = int(rng.choice([rng.integers(60, 100), rng.integers(113, 150)])), int(rng.integers(2**31))
                w[p] = v
                if p > 112 and v % 3:
                    w[p : p + 1] = [] if v % 3 == 1 else [v, v + 1]
            sides.append((w[99 : 99 - rule.side : -1], w[113 : 113 + rule.side]))
        left, right = (np.array([s[c] for s in sides], dtype="<u4") for c in range(2))
        i, j = np.triu_indices(90, 1)
        good = op2.linked(left, right, i, j, rule)
        roots = []
        for pairs in (np.stack([i[good], j[good]]), op2.links_by_keys(left, right, rule)):
            root = np.arange(90)
            for a, b in pairs.T:
                low, high = sorted((root[a], root[b]))
                root[root == high] = low
            roots.append(root.tolist())
        assert roots[0] == roots[1] and 3 < len(set(roots[0])) < 90
