"""Sharding by longest-processing-time scheduling.

Groups of equal texts stay together. Groups of at least a 512th of a shard are scheduled one by one;
there are at most shards x 512 of them. Smaller groups are first gathered by hash in as many bundles.
Both kinds, sorted by size, go to the least-loaded shard through a heap on the driver, which so holds
a bounded table whatever the input. Shards end up within about a bundle of each other, unless a single
group is larger than a shard.

Slots: rows of a unit are cut in cells by hash, cells are counted, and a row's slot is its cell's offset
plus its rank in the cell, so that no task orders a whole shard.

Size is the text's UTF-8 bytes plus 8; a null text has none and shares a group with other null texts.
Empty texts form a group of their own. Repeated rows get a slot each. Slots follow the rows' place in the
input files, so another layout of the same rows gives other slots, all gapless. Other columns are carried
on if asked for; one that is named like an operator's own gets an underscore.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARDS = 24
UNITS_PER_SHARD = 512
CELL_ROWS = 20_000
MAX_CELLS = 20_000


def lpt(units: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """Largest first, each to the least-loaded shard."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, name in sorted(units, key=lambda u: (-u[0], u[1])):
        load, s = heapq.heappop(heap)
        out[name] = s
        heapq.heappush(heap, (load + size, s))
    return out


OWN = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def plain_columns(docs: DataFrame, size: Column, text: Column, mark: Column) -> list[Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(text).alias("text_crc32"), mark.alias("mark")]


def carried(columns: list[str]) -> dict[str, str]:
    """The names under which the columns of a table are carried on: one that the operator has too gets underscores."""
    out: dict[str, str] = {}
    for c in columns:
        name = c
        while name.lower() in OWN or (name != c and name.lower() in {x.lower() for x in [*columns, *out.values()]}):
            name += "_"
        out[c] = name
    return out


def assign_shards(docs: DataFrame, shards: int = SHARDS, units_per_shard: int = UNITS_PER_SHARD, carry: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row; carry adds the other columns."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    mark = F.when(F.col("text").isNull(), F.lit("null")).otherwise(F.md5("text"))
    plain = docs.select(*plain_columns(docs, size, text, mark))
    if carry:
        plain = docs.select(*plain_columns(docs, size, text, mark), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    sized = written(plain.withColumn("row", F.monotonically_increasing_id()), "sized")
    total, rows = sized.agg(F.sum("size"), F.count("*")).first()
    most = shards * units_per_shard
    least = (total or 0) / most
    bundle = F.concat(F.lit("b"), F.pmod(F.xxhash64("mark"), F.lit(most)).cast("string"))
    groups = sized.groupBy("mark").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    units = groups.groupBy(F.when(F.col("size") >= least, F.col("mark")).otherwise(bundle).alias("unit")).agg(F.sum("size").alias("size"), F.sum("n").alias("n")).collect()
    shard_of = lpt([(u["size"], u["unit"]) for u in units], shards)  # ties by name
    cell_rows = max(CELL_ROWS, (rows or 0) // MAX_CELLS)
    table = spark.createDataFrame([(u["unit"], shard_of[u["unit"]], -(-u["n"] // cell_rows)) for u in units], "unit string, shard int, cells long")
    # at most 2 x shards x units_per_shard entries, whatever the input
    large = F.broadcast(table.filter("unit NOT LIKE 'b%' OR length(unit) = 32 OR unit = 'null'").select(F.col("unit").alias("mark"), F.lit(True).alias("is_large")))
    placed = sized.join(large, "mark", "left").withColumn("unit", F.when(F.col("is_large"), F.col("mark")).otherwise(bundle)).join(F.broadcast(table), "unit")
    placed = placed.withColumn("cell", F.pmod(F.xxhash64("row"), F.col("cells")))
    cells = placed.groupBy("shard", "unit", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("unit", "cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("unit", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("unit", "cell").orderBy(F.col("doc_id").asc_nulls_last(), "row"))
    slotted = placed.join(F.broadcast(offsets), ["unit", "cell"]).withColumn("slot", F.col("offset") + rank - 1)
    extra = [F.col("whole").getField(c).alias(name) for c, name in carried(docs.columns).items() if c != "doc_id"] if carry else []
    return slotted.select("doc_id", *extra, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
