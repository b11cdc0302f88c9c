"""The memory store: ingest, upsert, aggregates, the vector cache and the cold vault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


#: Columns that an upsert overwrites; the others keep what the store has.
CONTENT = ["summary", "content", "role", "task_type", "session_id", "time_bucket", "core_entities", "created_at", "source_date", "seq"]


def add_requests(requests: DataFrame, now: Column) -> DataFrame:
    """Messages of add requests as rows: blank ones dropped, roles and times filled in."""
    m = requests.select("request_id", "user_id", "session_id", F.posexplode("messages").alias("idx", "m"))
    user = F.coalesce(F.nullif(F.col("user_id"), F.lit("")), F.concat(F.lit("auto-"), "request_id"))
    out = m.select("request_id", user.alias("user_id"), "session_id", "idx", F.coalesce(F.nullif(F.trim("m.role"), F.lit("")), F.lit("unknown")).alias("role"), F.col("m.content").alias("content"), now.alias("created_at"))
    return out.filter(F.trim("content") != "")


def upsert(old: DataFrame, new: DataFrame, keep: list[str]) -> DataFrame:
    """old with the rows of new by memory_id: contents from new, the columns of keep from old where it has them.

    Among several new rows of an id the last by seq wins.
    """
    last = Window.partitionBy("memory_id").orderBy(F.col("seq").desc())
    new = new.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.expr("o.memory_id = n.memory_id"), "full_outer")
    pick = lambda c: F.coalesce(f"o.{c}", f"n.{c}") if c in keep else F.when(F.col("n.memory_id").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(*[(F.coalesce("n.memory_id", "o.memory_id") if c == "memory_id" else pick(c)).alias(c) for c in old.columns])


def scoped(df: DataFrame, users: list[str] | None = None, task_types: list[str] | None = None, buckets: list[str] | None = None, layer: str | None = None, sessions: list[str] | None = None) -> DataFrame:
    """The filter that every path shares; an empty list is no predicate."""
    for column, values in (("user_id", users), ("task_type", task_types), ("time_bucket", buckets), ("session_id", sessions)):
        if values:
            df = df.filter(F.col(column).isin(values))
    return df.filter(F.col("layer") == layer) if layer else df


def has_any(entities: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(entities, F.array(*[F.lit(w) for w in wanted]))


def phase1(df: DataFrame, queries: DataFrame, limit: int = 1000) -> DataFrame:
    """(q_id, memory_id) of each query's user: the hottest rows, cut first and filtered by the wanted entities after.

    queries has q_id, user_id and wanted, an array; an empty one is no predicate.
    """
    order = Window.partitionBy("q_id").orderBy(F.col("heat").desc(), F.col("created_at").desc(), "memory_id")
    rows = queries.join(df.select("user_id", "memory_id", "heat", "created_at", "core_entities"), "user_id")
    top = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit)
    return top.filter((F.size("wanted") == 0) | F.arrays_overlap("core_entities", "wanted")).select("q_id", "memory_id")


def at_place(df: DataFrame, column: str, place: DataFrame, ascending: bool = True) -> DataFrame:
    """The row whose value stands at `at` (from 0; one row of `place`) in order; values are range-sorted, not gathered in one task."""
    order = F.col(column).asc() if ascending else F.col(column).desc()
    ranged = written(df.select(column).repartitionByRange(order).withColumn("part", F.spark_partition_id()), "ranged")
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = ranged.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", before).crossJoin(place)  # a row for each partition
    wanted = parts.filter((F.col("before") <= F.col("at")) & (F.col("at") < F.col("before") + F.col("n")))
    rows = ranged.join(F.broadcast(wanted), "part").withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1)
    return rows.filter("place = at").select(column)


def heat_percentile(df: DataFrame, p: float) -> DataFrame:
    """The heat at place floor(n * (1 - p)) of the heats in descending order."""
    n = df.agg(F.floor(F.count("*") * (F.lit(1.0) - F.lit(float(p)))).alias("at"))
    return at_place(df, "heat", n, ascending=False)


def vec_cache_key(model: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(model), F.char(F.lit(0)), text), 256)


def vec_cache_put(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Later rows replace earlier ones of their key."""
    both = cache.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(F.col("_v").desc()))).filter("_n = 1").drop("_n", "_v")


def vec_cache_coverage(cache: DataFrame, texts: DataFrame) -> DataFrame:
    found = texts.select("key").distinct().join(cache.select("key", F.lit(1).alias("hit")), "key", "left")
    return found.agg(F.count("*").alias("candidates"), F.count("hit").alias("cached")).select("candidates", "cached", (F.col("candidates") - F.col("cached")).alias("missing"), F.coalesce(F.round(F.col("cached") / F.nullif(F.col("candidates"), F.lit(0)), 4), F.lit(1.0)).alias("ratio"))


def vec_cache_prune(cache: DataFrame, keep: DataFrame) -> DataFrame:
    return cache.join(keep.select("key"), "key", "left_semi")


def vec_cache_clear(cache: DataFrame, path: str) -> None:
    """The cache's table at path without a row."""
    cache.limit(0).write.mode("overwrite").parquet(path)


def heat_update(df: DataFrame, deltas: DataFrame) -> DataFrame:
    d = deltas.groupBy("memory_id").agg(F.sum("d_heat").alias("d_heat"), F.sum("d_count").alias("d_count"))
    out = df.join(d, "memory_id", "left")
    return out.withColumn("heat", F.greatest(F.lit(0.0), F.col("heat") + F.coalesce("d_heat", F.lit(0.0)))).withColumn("count", F.col("count") + F.coalesce("d_count", F.lit(0))).select(*df.columns)


def heat_decay(heat: Column, days: Column, rate: float = 0.05) -> Column:
    return F.greatest(F.lit(0.0), heat * F.exp(-rate * days))


ENTRY = "struct<id:string,entry_id:string,user:string,assistant:string,text:string,summary:string>"


def entries(lines: DataFrame) -> DataFrame:
    """(date, line, entry) of a vault's JSON lines with what they hold; those without an id have a null eid."""
    text, label = source_text("e")
    rows = lines.withColumn("e", F.from_json("entry", ENTRY)).withColumn("eid", F.coalesce("e.id", "e.entry_id"))
    rows = rows.withColumn("memory_id", F.when(F.col("eid").isNotNull(), F.substring(F.md5(F.concat_ws("#", "date", "eid")), 1, 12)))
    return rows.withColumn("source_text", text).withColumn("source", label)


def cold_index(lines: DataFrame) -> DataFrame:
    """The vault's index: bad lines out, ids recomputed, the last of an id stays."""
    last = Window.partitionBy("memory_id").orderBy(F.col("line").desc())
    rows = entries(lines).filter("eid IS NOT NULL")
    return rows.withColumn("n", F.row_number().over(last)).filter("n = 1").select("memory_id", "date", "eid", "line", "source_text", "source")


def cold_locate(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """The first line of each wanted memory_id."""
    first = Window.partitionBy("memory_id").orderBy("line")
    rows = entries(lines).filter("eid IS NOT NULL").join(wanted.select("memory_id").distinct(), "memory_id", "left_semi")
    return rows.withColumn("n", F.row_number().over(first)).filter("n = 1").select("memory_id", "date", "eid", "line", "source_text", "source")


def vault_stats(lines: DataFrame) -> DataFrame:
    """Counts of a rebuild: lines, rows, what was passed over and why, and where the texts are from."""
    kind = F.get_json_object("entry", "$")
    bad, array = kind.isNull(), kind.isNotNull() & ~F.trim(kind).startswith("{")
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    known = F.col("eid").isNotNull()
    return entries(lines).agg(
        F.count("*").alias("scanned"), F.count("eid").alias("rows"), count(bad, "bad_lines"), count(array, "no_objects"), count(~known & ~bad & ~array, "no_ids"),
        *[count(known & (F.col("source") == s), s if s != "none" else "no_text") for s in ("orig", "text", "summary", "none")],
        F.countDistinct("memory_id").alias("ids"), F.countDistinct("date").alias("days"),
    )


def source_text(e: str) -> tuple[Column, Column]:
    """The original exchange, else the text, else the summary; and which it is."""
    full = lambda c: F.nullif(F.trim(F.coalesce(f"{e}.{c}", F.lit(""))), F.lit(""))
    orig = F.nullif(F.concat_ws("\n", full("user"), full("assistant")), F.lit(""))
    return F.coalesce(orig, full("text"), full("summary"), F.lit("")), F.when(orig.isNotNull(), "orig").when(full("text").isNotNull(), "text").when(full("summary").isNotNull(), "summary").otherwise("none")


def schema_align(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    for name, value in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, value)
    return df


def share_check(df: DataFrame, column: str, fallback: str) -> DataFrame:
    """Whether a vocabulary is balanced: no value above 40 %, the fallback not above 10 %."""
    by = df.groupBy(F.coalesce(column, F.lit(fallback)).alias("value")).agg(F.count("*").alias("n"))
    by = by.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return by.agg(F.sum("n").alias("n"), F.max("share").alias("max_share"), F.coalesce(F.max(F.when(F.col("value") == fallback, F.col("share"))), F.lit(0.0)).alias("fallback_share")).withColumn("ok", (F.col("max_share") <= 0.4) & (F.col("fallback_share") <= 0.1))


