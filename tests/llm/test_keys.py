"""Rows are told by doc_id where it is unique, by a key of their own where not: both must give the same."""

import pytest

from remora.llm import op01_suffix_dedup as op1
from remora.llm import op02_passages as op2
from remora.llm import op06_near_dedup as op6
from remora.llm import op07_license_scan as op7
from remora.llm import op10_decontaminate as op10

from .test_operators import DOCS, made

ALONE = 10**6
OPERATORS = {
    "op1": op1.remove_repeats,
    "op2": op2.repeated_passages,
    "op6": op6.classify,
    "op7": lambda df: op7.scan_licenses(df).drop("spans"),
    "op10": lambda df: op10.find_leaks(df, df.filter("doc_id IN (4, 9)").selectExpr("cast(doc_id AS string) AS item_id", "text")).drop("items", "hits"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_repeated_doc_id_leaves_other_rows_as_they_are(spark, name):
    rows = made(31, 50)
    lone = [(ALONE, "quite alone", "en", "a"), (ALONE, "alone as well", "en", "a"), (None, "no name", "en", "a")]
    found = []
    for data in (rows, rows + lone):
        out = OPERATORS[name](spark.createDataFrame(data, DOCS))
        columns = sorted(out.columns)
        found.append(sorted((tuple(str(r[c]) for c in columns) for r in out.collect() if r.doc_id is not None and r.doc_id != ALONE)))
    assert found[0] and found[0] == found[1]
