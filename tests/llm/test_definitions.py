"""Operators that have no SQL against plain versions of what their docstrings say."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from remora.llm import op04_quality as op4
from remora.llm import op05_fertility as op5
from remora.llm import op07_license_scan as op7

from .test_operators import DOCS, made, words


def test_op7_base_equals_a_naive_scan(spark):
    rng = random.Random(21)
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    parts = [*phrases, "gnu", "general", "public", "license", "apache", "cc", "by", "mit", "licenses", "é", "gnu general public"]
    rows = [(i, "".join(rng.choice([p, p.upper(), p.title()]) + rng.choice([" ", "\n", "-", ", ", "\t(", "_"]) for p in (rng.choice(parts) for _ in range(rng.randint(0, 40))))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "mit license " * 5000), (203, "apache " * 3 + "license"), (204, "gnu general public"), (205, "license")]
    got = {r.doc_id: r for r in op7.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for k, t in rows:
        w = words(t)
        places = [(i, label) for phrase, label in phrases.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        r = got[k]
        want = sorted({label for _, label in places})
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(places), ",".join(want)), k
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None)), k
        assert set(want) <= set(r.labels.split(",")) or not want
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_op4_posterior_equals_its_formulas(spark):
    rng = random.Random(22)
    rows = [(i, rng.choice(["a"] * 6 + ["b", "c", None]), rng.choice(["en", "fr", None]), rng.uniform(-6, 6)) for i in range(400)]
    rows += [(500, "lone", "en", -4.0), (501, "lone", None, 4.0), (502, "once", "en", -11.0), (502, "once", "en", -11.0)]
    paths, hosts = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for _, host, path, odds in rows:
        for sums in (paths[host, path], hosts[host]):
            sums[0] += 1
            sums[1] += round(1e6 / (1 + math.exp(-odds)))
    overall = sum(g for _, g in hosts.values()) / len(rows) / 1e6

    def strength(sites):
        mean = lambda x: sum(x) / len(sites)
        noise = mean([p * (1 - p) for _, _, p in sites])
        between = max(mean([(r - p) ** 2 for r, _, p in sites]) - mean([p * (1 - p) / n for _, n, p in sites]), 1e-6)
        return min(max(noise / between - 1, 1.0), 1e4)

    hs = strength([(g / n / 1e6, n, overall) for n, g in hosts.values()])
    host_rate = {h: (g / 1e6 + hs * overall) / (n + hs) for h, (n, g) in hosts.items()}
    ps = strength([(g / n / 1e6, n, host_rate[h]) for (h, _), (n, g) in paths.items()])
    path_rate = {(h, p): (g / 1e6 + ps * host_rate[h]) / (n + ps) for (h, p), (n, g) in paths.items()}
    logit = lambda x: math.log(x / (1 - x))
    got = op4.posterior(spark.createDataFrame(rows, "doc_id long, host string, path string, odds double")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.host_rate == pytest.approx(host_rate[r.host], abs=1e-9) and r.path_rate == pytest.approx(path_rate[r.host, r.path], abs=1e-9)
        odds = r.odds + op4.TRUST * (logit(path_rate[r.host, r.path]) - logit(overall))
        assert r.score == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-9)


def test_op5_measures_and_bands_equal_their_definition(spark):
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=op5.VOCABULARY)
    rng = random.Random(23)
    rows = made(24, 100)
    rows += [(500 + i, " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(60)), "en", "a") for i in range(120)]
    rows += [(300 + i, " ".join("".join(chr(rng.randint(0xA000, 0xA3FF)) for _ in range(4)) for _ in range(60)), "en", "a") for i in range(2)]
    rows += [(400, "日本語 テキスト " * 3 + " ".join(str(i) for i in range(80)), None, None), (401, "SHOUT | ## " + " ".join(f"{i}%" for i in range(90)), "fr", "a")]
    got = {r.doc_id: r for r in op5.rate_fertility(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(got) == len(rows)
    want, tongues = {}, {}
    for k, t, lang, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        tokens = [x for one in w for x in pieces.encode(one)]
        n, count = len(tokens), Counter(tokens)
        entropy = -sum(c / n * math.log2(c / n) for c in count.values()) / math.log2(max(2, n)) if n else 0.0
        want[k] = (sum(map(len, w)) / n if n else 0.0, sum(pieces.is_byte(x) for x in tokens) / n if n else 0.0, entropy)
        tongues[k] = lang or ("other script" if re.search("[Ͱ-῿぀-힯]", t or "") else "latin script")
        assert got[k].n_tokens == n
        assert (got[k].chars_per_token, got[k].byte_share, got[k].entropy) == pytest.approx(want[k], abs=1e-9)
        assert got[k].tongue == tongues[k]
    bands = {}
    for tongue in set(tongues.values()):
        for x in range(3):
            cells = sorted(math.floor(want[k][x] * op5.GRID + 0.5) for k in want if tongues[k] == tongue and not got[k].base_failed)
            if cells:
                low, high = (next(c for i, c in enumerate(cells) if sum(y <= c for y in cells) >= q * len(cells)) / op5.GRID for q in (0.05, 0.95))
                width = max(high - low, 2.0 / op5.GRID)
                bands[tongue, x] = (low - op5.REACH * width, high + op5.REACH * width)
    rejected = 0
    for k in want:
        inside = all(bands[tongues[k], x][0] <= want[k][x] <= bands[tongues[k], x][1] for x in range(3) if (tongues[k], x) in bands)
        assert got[k].kept == (inside and not got[k].base_failed), k
        rejected += not inside and not got[k].base_failed
    assert rejected  # the bands decide something here
