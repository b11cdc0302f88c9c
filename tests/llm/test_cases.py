"""Nulls, empty tables, repeated rows, very long texts and clashing columns, for every operator and stage."""

import pytest

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

SCHEMA = "doc_id long, text string, lang string, source string, score string, k string, size string, target string, shard string, row string, items string, g string, rank string, unit string"
LONG = "many words " * 60_000
ROWS = [(i, t, lang, s, *["x"] * 10) for i, t, lang, s in [(1, "a b c", "en", "s"), (1, "a b c", "en", "s"), (1, "other text", None, "t"), (None, "null id", "fr", None), (None, None, None, None), (3, "", "de", ""), (4, LONG, "en", "s")]]


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int")


def items(spark):
    return spark.createDataFrame([(1, "a b c"), (None, None)], "item_id long, text string")


OPERATORS = {
    "op1": (lambda s, d: op1.remove_repeats(d), 7),
    "op2": (lambda s, d: op2.repeated_passages(d), None),
    "op3": (lambda s, d: op3.score_toxicity(d, labels(s)), 7),
    "op4": (lambda s, d: op4.rate_quality(d, labels(s)), 7),
    "op5": (lambda s, d: op5.rate_fertility(d), 7),
    "op6": (lambda s, d: op6.classify(d), 7),
    "op7": (lambda s, d: op7.scan_licenses(d), 7),
    "op8": (lambda s, d: op8.assign_shards(d), 7),
    "op9": (lambda s, d: op9.mix_sources(d), 7),
    "op10": (lambda s, d: op10.find_leaks(d, items(s)), 7),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    run, n = OPERATORS[name]
    got = run(spark, spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert n is None or len(got) == n
    assert not got or "doc_id" in got[0].asDict()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    run, _ = OPERATORS[name]
    assert run(spark, spark.createDataFrame([], SCHEMA)).collect() == []


def test_repeated_rows_are_removed_or_merged(spark):
    rows = [(7, "word " * 40), (7, "word " * 40), (8, "word " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = op1.remove_repeats(df).collect()
    # the first row keeps what does not repeat in itself; the two others go whole
    assert sorted(r.n_removed for r in out)[1:] == [200, 200]
    assert {r.class_id for r in op6.classify(df).collect()} == {7} and sum(r.kept for r in op6.classify(df).collect()) == 1


def test_no_items(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = op10.find_leaks(df, items(spark).limit(0)).collect()
    assert len(got) == 7 and not any(r.contaminated for r in got)


def test_pipeline_stages(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    odd = spark.createDataFrame(ROWS, SCHEMA)
    for df in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, sf)
            if name != "sharding":
                assert out.columns == df.columns, name
            else:
                assert {"doc_id", "text", "shard", "slot"} <= set(out.columns)
            assert df.count() or not out.count()


def test_pipeline_equals_its_operators(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    want = {r.doc_id for r in op6.classify(docs).filter("kept").collect()}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == want
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    leaked = {r.doc_id for r in op10.find_leaks(docs, bench).filter("contaminated").collect()}
    left = {r.doc_id for r in corpus_pipeline.drop_leaks(spark, docs, sf).select("doc_id").collect()}
    assert left == {r.doc_id for r in docs.select("doc_id").collect()} - leaked
    mixed = corpus_pipeline.mix(spark, docs, sf).groupBy("doc_id").count().collect()
    taken = {r.doc_id: r.taken // r.size for r in op9.mix_sources(docs).filter("taken > 0").collect()}
    assert {r.doc_id: r["count"] for r in mixed} == taken
    assert corpus_pipeline.run(spark, sf).count() > 0


CLASH = ["_k", "_h", "_whole", "score", "score_", "mark", "row", "size", "size_", "shard", "slot", "law", "whole", "unit", "cell", "k", "root", "rep", "taken", "source_size", "r"]


def test_stages_carry_columns_of_any_name(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    texts = {1: "the calm river runs " * 3, 2: None, 3: "", 4: "green hills and stone houses by the sea " * 2}
    rows = [(i, t, "s", *[f"{c}{i}" for c in CLASH]) for i, t in texts.items()] + [(4, texts[4], "s", *[f"{c}5" for c in CLASH])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASH))
    want = {r[-1]: tuple(r) for r in rows}
    kept = {"toxicity": {"r1", "r2", "r3", "r4", "r5"}, "decontamination": {"r1", "r2", "r3", "r4", "r5"}}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, df, sf).collect()
        if name == "sharding":
            names = {c: c if c not in ("size", "shard", "slot", "law") else c + ("__" if c == "size" else "_") for c in CLASH}
            assert {tuple([r.doc_id, r.text, r.source, *[r[names[c]] for c in CLASH]]) for r in got} == set(want.values())
            assert {r["size"] for r in got if r.text is None} == {8} and sorted(r.slot for r in got if r.text == texts[4]) != [0, 0]
            continue
        assert all(tuple(r) == want[r[-1]] for r in got), name
        if name == "near_dedup":  # null and empty texts are equal, and so are the two rows of document 4
            assert {r.doc_id for r in got} == {1, 2, 4} and len(got) == 3
        elif name == "mixing":
            assert all(r.text for r in got)
        else:
            assert {r[-1] for r in got} == kept[name]


def test_a_cluster_must_name_a_shared_folder(monkeypatch):
    from remora.llm import common

    class Conf(dict):
        def get(self, k, default=""):
            return dict.get(self, k, default)

    class Spark:
        conf = Conf()

        class sparkContext:
            getConf = staticmethod(lambda: Conf({"spark.master": "spark://host:7077"}))

    with pytest.raises(ValueError):
        common.shared_dir(Spark())


def test_blocks_of_items_keep_their_bound(spark):
    long = "\n".join(f"w{i}" for i in range(5000))
    df = spark.createDataFrame([(1, long), (2, "a b c"), (2, None), (3, "x " * 30)], "item_id long, text string")
    found = list(op10.item_blocks(df, 10, 700))
    sizes = [len(op10.Windows(ids, texts, 10).words) for ids, texts in found]
    assert max(sizes) <= 700 and len(found) > 7
    every = {w.tobytes() for ids, texts in found for w in op10.Windows(ids, texts, 10).words}
    assert every == {w.tobytes() for w in op10.Windows([1, 2, 3], [long, "a b c", "x " * 30], 10).words}
