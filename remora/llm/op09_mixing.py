"""Mixing sources to target weights by weighted fair queueing.

Every document gets a virtual finish time: the tokens its source has queued up to it, in a shuffled
order, over the source's target. Where a target exceeds its source, the documents queue a second time.
The copies of all sources are range-sorted by finish time across the cluster and taken until the
budget of all targets is spent. Whole documents are taken, so that a source ends within about a
document of its target.

Targets: sources by code point, null last, weigh 3, 1, 2, repeating, and share 150 % of all sizes; a
target stops at twice its source's size, and the excess goes to the others by weight until none is
above. Prefix sums run in cells of a source (by the first digits of the shuffling hash), so a source
with a third of all rows is no single task.

Size is the number of blank-separated words; null and blank texts have 0 and are never taken (a source
of only such texts has target 0). The shuffle depends on doc_id and text: reruns agree, and repeated
rows stay rows of their own. Other columns are ignored, or carried on by mixed().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2
SEED = "mix"
WORD = "[^\\x20\\x09-\\x0D]+"


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, limit: int) -> DataFrame:
    """(source, source_size, target): shares by weight, filled up to the limit from the lowest ratio on."""
    name = F.col("source").asc_nulls_last()
    s = sources.withColumn("rank", F.row_number().over(Window.orderBy(name)))
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * float(limit)).withColumn("ratio", F.col("cap") / F.col("w"))
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("budget", F.sum("source_size").over(everything) * float(share)).withColumn("all_w", F.sum("w").over(everything))
    s = s.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    s = s.withColumn("water", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(everything)["level"])
    return s.select("source", "source_size", F.when(F.col("water").isNull() | (F.col("ratio") < F.col("water")), F.col("cap")).otherwise(F.col("water") * F.col("w")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT, seed: str = SEED, carry: bool = False) -> DataFrame:
    """doc_id, size, source_size, target and taken of each row; carry adds the other columns."""
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    made = [F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), size.alias("size"), key.alias("r")]
    rest = [c for c in docs.columns if carry and c not in ("doc_id", "text", "source", "size", "r", "row", "cell", "source_size", "target", "taken")]
    sized = written(docs.select(*made, *rest).withColumn("row", F.monotonically_increasing_id()).withColumn("cell", F.substring("r", 1, 3)), "sized")
    cells = sized.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    wanted = targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, share, limit)
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("offset", F.coalesce(F.sum("cell_size").over(before), F.lit(0)))
    cells = cells.alias("c").join(wanted.alias("t"), F.expr("c.source <=> t.source")).select("c.source", "c.cell", "c.offset", "t.source_size", "t.target")
    slim = sized.select("row", "doc_id", "source", "size", "r", "cell")
    queued = slim.alias("d").join(cells.alias("c"), F.expr("d.source <=> c.source AND d.cell = c.cell")).select("d.*", "c.offset", "c.source_size", "c.target")
    upto = F.sum("size").over(Window.partitionBy("source", "cell").orderBy("r", "row").rowsBetween(Window.unboundedPreceding, 0))
    queued = queued.withColumn("upto", F.col("offset") + upto)
    copies = queued.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(limit - 1))))
    finish = (F.col("upto") + F.col("copy") * F.col("source_size")).cast("double") / F.nullif(F.col("target"), F.lit(0.0))
    order = [F.col("finish").asc_nulls_last(), F.col("source").asc_nulls_last(), F.col("copy").asc(), F.col("r").asc(), F.col("row").asc()]
    ranged = copies.select("row", "doc_id", "source", "size", "r", "source_size", "target", "copy", finish.alias("finish")).repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "ranged")
    parts = ranged.groupBy("part").agg(F.sum("size").alias("n"))  # a row for each partition of the range sort
    budget = sized.agg((F.coalesce(F.sum("size"), F.lit(0)) * float(share)).alias("budget"))
    parts = parts.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).crossJoin(budget)
    within = F.sum("size").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    counted = ranged.withColumn("within", within).join(F.broadcast(parts.drop("n")), "part")
    take = F.when(F.col("finish").isNotNull() & (F.col("base") + F.col("within") <= F.col("budget")), F.col("size")).otherwise(0)
    out = counted.groupBy("row", "doc_id", "size", "source_size", "target").agg(F.sum(take).alias("taken"))
    if carry:
        return sized.select("row", "source", *rest).join(out, "row").drop("row")
    return out.select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs as mixed: rows that the mix takes twice come twice, rows that it leaves out are gone."""
    # all columns travel in one, whatever their names
    kept = [c for c in ("doc_id", "text", "source") if c in docs.columns]
    packed = docs.select(*kept, F.struct(*docs.columns).alias("_whole"))
    out = mix_sources(packed, carry=True, **options)
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    out = out.select("_whole", times.alias("times")).filter("times > 0")
    return out.select("_whole", F.explode(F.sequence(F.lit(1), F.col("times")))).select("_whole.*")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS r
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s0),
s2 AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
       source_size * 2.0::DOUBLE AS cap FROM s1),
s3 AS (SELECT *, cap / w AS ratio, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget, sum(w) OVER () AS all_w FROM s2),
s4 AS (SELECT *, (budget - coalesce(sum(cap) OVER o, 0)) / (all_w - coalesce(sum(w) OVER o, 0)) AS level FROM s3
       WINDOW o AS (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s5 AS (SELECT arg_min(level, ROW(ratio, rank)) FILTER (WHERE level <= ratio) AS water FROM s4),
s AS (SELECT source, source_size, budget, CASE WHEN water IS NULL OR ratio < water THEN cap ELSE water * w END AS target FROM s4, s5),
q AS (SELECT d.doc_id, d.source, d.size, d.r, s.source_size, s.target, s.budget,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.r ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
c AS (SELECT q.*, copy, (upto + copy * source_size)::DOUBLE / nullif(target, 0) AS finish FROM q, (VALUES (0), (1)) v(copy)),
t AS (SELECT *, sum(size) OVER (ORDER BY finish NULLS LAST, source NULLS LAST, copy, r ROWS UNBOUNDED PRECEDING) AS upto_all FROM c)
SELECT doc_id, size, source_size, target, sum(CASE WHEN finish IS NOT NULL AND upto_all <= budget THEN size ELSE 0 END)::BIGINT AS taken
FROM t GROUP BY doc_id, r, size, source_size, target
"""
