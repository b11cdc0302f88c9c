"""Registered queries of the store, its aggregates and the text functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.vocab import CHILD_POLICY, CLASS_FALLBACK, CLASSES, POLICY, TASK_FALLBACK, TASK_KEYWORDS, TASK_TYPES
from ..operators import store as S
from ..sources import views as V
from .retrieval_queries import tokens_sql

QUERIES: dict = {}
SQL: dict = {}
MEM = f"WITH {V.MEMORIES}"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"{MEM} SELECT memory_id, user_id, session_id, role, content, summary, created_at, time_bucket, seq FROM memories")
def memories_scan(spark, sf_dir):
    return V.memories(spark, sf_dir).select("memory_id", "user_id", "session_id", "role", "content", "summary", "created_at", "time_bucket", "seq")


@query("SELECT 'r' || conv_id AS request_id, 'u' || (conv_id % 10) AS user_id, 's' || conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, coalesce(nullif(trim(role), ''), 'unknown') AS role, text AS content FROM conversations QUALIFY trim(text) <> ''")
def add_ingest(spark, sf_dir):
    return S.add_requests(V.messages(spark, sf_dir), F.lit("2023-01-01T00:00:00+00:00")).drop("created_at")


_UPSERTED = f"""{MEM}, new AS (SELECT memory_id, 'new: ' || content AS summary, 5.0 AS heat FROM memories WHERE role = 'user')
SELECT m.memory_id, coalesce(new.summary, m.summary) AS summary, m.heat, m.user_id FROM memories m LEFT JOIN new USING (memory_id)"""


def _upserted(spark, sf_dir):
    old = V.memories(spark, sf_dir)
    new = old.filter("role = 'user'").withColumn("summary", F.concat(F.lit("new: "), "content")).withColumn("heat", F.lit(5.0))
    return S.upsert(old, new, ["heat", "count", "layer", "user_id"])


@query(_UPSERTED)
def upsert(spark, sf_dir):
    return _upserted(spark, sf_dir).select("memory_id", "summary", "heat", "user_id")


@query(f"{MEM} SELECT memory_id, summary FROM memories")
def bulk_insert(spark, sf_dir):
    m = V.memories(spark, sf_dir)
    return S.upsert(m.limit(0), m, ["heat"]).select("memory_id", "summary")


@query(f"{MEM} SELECT memory_id, summary FROM memories WHERE user_id = 'u1'")
def insert_memory(spark, sf_dir):
    m = V.memories(spark, sf_dir).filter("user_id = 'u1'")
    return S.upsert(m.filter("role <> 'user'"), m.filter("role = 'user'"), ["heat"]).select("memory_id", "summary")


@query(f"{MEM} SELECT count(*) AS n, count(DISTINCT memory_id) AS ids FROM memories")
def idempotent_replay(spark, sf_dir):
    m = V.memories(spark, sf_dir)
    return S.upsert(m, m, ["heat"]).agg(F.count("*").alias("n"), F.countDistinct("memory_id").alias("ids"))


@query(f"{MEM} SELECT memory_id FROM memories WHERE user_id IN ('u1', 'u2') AND time_bucket = '2023-01' AND layer = 'cold'")
def filter_where(spark, sf_dir):
    return S.scoped(V.memories(spark, sf_dir), users=["u1", "u2"], buckets=["2023-01"], layer="cold", sessions=[]).select("memory_id")


@query(f"{MEM} SELECT memory_id FROM memories WHERE list_has_any(core_entities, ['The', 'Les', 'Des', 'Ing'])")
def entity_any(spark, sf_dir):
    return V.memories(spark, sf_dir).filter(S.has_any(F.col("core_entities"), ["The", "Les", "Des", "Ing"])).select("memory_id")


@query(f"""{MEM}, h AS (SELECT * REPLACE ((seq % 7)::DOUBLE AS heat) FROM memories), q AS (SELECT 'u' || i AS user_id, i AS q_id, CASE WHEN i % 3 = 0 THEN []::VARCHAR[] ELSE ['The', 'Les', 'Des', 'Ing'] END AS wanted, n FROM range(0, 10) r(i), (VALUES (1000), (15)) v(n)),
t AS (SELECT q_id, n, memory_id, wanted, core_entities, row_number() OVER (PARTITION BY q_id, n ORDER BY h.heat DESC, created_at DESC, memory_id) AS place FROM q JOIN h USING (user_id))
SELECT q_id, n, memory_id FROM t WHERE place <= n AND (len(wanted) = 0 OR list_has_any(core_entities, wanted))""")
def phase1(spark, sf_dir):
    """The hottest rows of each of ten users, by the full limit and a small one; two of three ask for names."""
    m = V.memories(spark, sf_dir).withColumn("heat", (F.col("seq") % 7).cast("double"))
    some = F.array(*map(F.lit, ["The", "Les", "Des", "Ing"]))
    q = spark.range(10).select(F.concat(F.lit("u"), "id").alias("user_id"), F.col("id").alias("q_id"), F.when(F.col("id") % 3 == 0, F.array().cast("array<string>")).otherwise(some).alias("wanted"))
    parts = [S.phase1(m, q, n).select("q_id", F.lit(n).alias("n"), "memory_id") for n in (1000, 15)]
    return parts[0].unionByName(parts[1])


@query(f"{MEM} SELECT m.memory_id, m.user_id FROM memories m JOIN (SELECT DISTINCT memory_id FROM memories WHERE role = 'system') USING (memory_id) WHERE user_id IN ('u1', 'u3')")
def get_by_ids(spark, sf_dir):
    m = V.memories(spark, sf_dir)
    return S.scoped(m, users=["u1", "u3"]).join(m.filter("role = 'system'").select("memory_id").distinct(), "memory_id").select("memory_id", "user_id")


@query(f"{MEM} SELECT count(*) AS n FROM memories")
def count_total(spark, sf_dir):
    return V.memories(spark, sf_dir).agg(F.count("*").alias("n"))


@query(f"{MEM} SELECT coalesce(nullif(layer, ''), 'unknown') AS layer, count(*) AS n FROM memories GROUP BY 1")
def layer_dist(spark, sf_dir):
    return V.memories(spark, sf_dir).groupBy(F.coalesce(F.nullif("layer", F.lit("")), F.lit("unknown")).alias("layer")).agg(F.count("*").alias("n"))


@query(f"{MEM} SELECT user_id, count(*) AS n FROM memories GROUP BY 1 ORDER BY n DESC, user_id LIMIT 1")
def user_counts(spark, sf_dir):
    return V.memories(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(1)


@query(f"{MEM} SELECT memory_id, heat, count, layer FROM memories")
def members(spark, sf_dir):
    return V.memories(spark, sf_dir).select("memory_id", "heat", "count", "layer")


@query(f"{MEM} SELECT user_id, strftime(max(source_date), '%Y-%m-%d') AS latest FROM memories GROUP BY user_id")
def max_source_date(spark, sf_dir):
    return V.memories(spark, sf_dir).groupBy("user_id").agg(F.date_format(F.max("source_date"), "yyyy-MM-dd").alias("latest"))


_HEAT = "SELECT user_id, count(*)::DOUBLE AS heat FROM events GROUP BY user_id"


def _heat(spark, sf_dir):
    return V.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").cast("double").alias("heat"))


@query(f"WITH h AS ({_HEAT}), r AS (SELECT heat, row_number() OVER (ORDER BY heat DESC) AS n FROM h) SELECT heat FROM r WHERE n = floor((SELECT count(*) FROM h) * (1 - 0.9::DOUBLE)) + 1")
def heat_percentile(spark, sf_dir):
    return S.heat_percentile(_heat(spark, sf_dir), 0.9)


@query("SELECT user_id, round(greatest(0, count(*) * exp(-0.05::DOUBLE * date_diff('day', max(ts)::DATE, DATE '2024-02-15'))), 6) AS heat FROM events GROUP BY user_id")
def heat_decay(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").cast("double").alias("heat"), F.max("ts").alias("last"))
    return e.select("user_id", F.round(S.heat_decay(F.col("heat"), F.datediff(F.lit("2024-02-15").cast("date"), F.to_date("last"))), 6).alias("heat"))


@query(f"{MEM}, d AS (SELECT 'u' || (user_id % 10) AS u, sum(CASE WHEN event_type = 'click' THEN 1.0 ELSE -0.25 END)::DOUBLE AS dh, count(*) AS dc FROM events GROUP BY 1) SELECT memory_id, greatest(0, heat + coalesce(dh, 0)) AS heat, count + coalesce(dc, 0) AS count FROM memories LEFT JOIN d ON user_id = u")
def heat_update(spark, sf_dir):
    m = V.memories(spark, sf_dir)
    d = V.table(spark, sf_dir, "events").groupBy(F.concat(F.lit("u"), F.col("user_id") % 10).alias("user_id")).agg(F.sum(F.when(F.col("event_type") == "click", 1.0).otherwise(-0.25)).alias("d_heat"), F.count("*").alias("d_count"))
    deltas = m.select("memory_id", "user_id").join(d, "user_id").select("memory_id", "d_heat", "d_count")
    return S.heat_update(m, deltas).select("memory_id", "heat", "count")


@query(f"{MEM} SELECT memory_id, CASE WHEN role = 'system' THEN 'hot' ELSE layer END AS layer FROM memories")
def layer_update(spark, sf_dir):
    return V.memories(spark, sf_dir).select("memory_id", F.when(F.col("role") == "system", "hot").otherwise(F.col("layer")).alias("layer"))


@query("WITH s AS (SELECT *, row_number() OVER (ORDER BY value, event_id) AS r, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) SELECT round(median(value), 6) AS p50, round(max(value) FILTER (r = greatest(0, floor(n * 0.95::DOUBLE) - 1) + 1), 6) AS p95 FROM s")
def latency_pcts(spark, sf_dir):
    v = V.table(spark, sf_dir, "events").filter("value IS NOT NULL").select("value")
    at = v.agg(F.greatest(F.lit(0), F.floor(F.count("*") * F.lit(0.95)) - 1).alias("at"))
    low, high = (v.agg(f((F.count("*") - 1) / 2).cast("long").alias("at")) for f in (F.floor, F.ceil))
    p50 = S.at_place(v, "value", low).crossJoin(S.at_place(v, "value", high).withColumnRenamed("value", "other"))  # one row each
    return p50.crossJoin(S.at_place(v, "value", at).withColumnRenamed("value", "p95")).select(F.round((F.col("value") + F.col("other")) / 2, 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("WITH g AS (SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1), s AS (SELECT *, n / sum(n) OVER () AS share FROM g) SELECT sum(n)::BIGINT AS n, round(max(share), 6) AS max_share, round(coalesce(max(share) FILTER (value = 'click'), 0), 6) AS fallback_share, max(share) <= 0.4 AND coalesce(max(share) FILTER (value = 'click'), 0) <= 0.1 AS ok FROM s")
def vocab_validate(spark, sf_dir):
    return S.share_check(V.table(spark, sf_dir, "events"), "event_type", "click").select("n", F.round("max_share", 6).alias("max_share"), F.round("fallback_share", 6).alias("fallback_share"), "ok")


@query(f"{MEM} SELECT count(*) AS n, count(*) FILTER (role = '') AS no_role, count(*) FILTER (regexp_matches(content, '^\\[\\d{{4}}-\\d{{2}}-\\d{{2}}\\] \\[')) AS double_dates, max(m) AS largest_session FROM (SELECT *, count(*) OVER (PARTITION BY user_id, session_id) AS m FROM memories)")
def format_audit(spark, sf_dir):
    m = V.memories(spark, sf_dir)
    per = m.groupBy("user_id", "session_id").agg(F.count("*").alias("m"), F.count(F.when(F.col("role") == "", 1)).alias("a"), F.count(F.when(F.col("content").rlike("^\\[\\d{4}-\\d{2}-\\d{2}\\] \\["), 1)).alias("b"))
    return per.agg(F.sum("m").alias("n"), F.sum("a").alias("no_role"), F.sum("b").alias("double_dates"), F.max("m").alias("largest_session"))


_LANG = "CASE WHEN regexp_count_cjk + latin = 0 THEN 'unk' WHEN regexp_count_cjk / (regexp_count_cjk + latin) >= 0.6 THEN 'zh' WHEN regexp_count_cjk / (regexp_count_cjk + latin) <= 0.1 THEN 'en' ELSE 'mix' END"
_COUNTED = f"{MEM}, l AS (SELECT memory_id, content, len(regexp_extract_all(content, '[\\x{{4e00}}-\\x{{9fff}}]')) AS regexp_count_cjk, len(regexp_extract_all(content, '[A-Za-z]')) AS latin FROM memories)"


@query(f"{_COUNTED} SELECT memory_id, {_LANG} AS lang FROM l")
def raw_lang(spark, sf_dir):
    return V.memories(spark, sf_dir).select("memory_id", X.raw_lang(F.col("content")).alias("lang"))


@query(f"{_COUNTED} SELECT {_LANG} AS lang, count(*) AS n, count(*) FILTER (latin = 0) AS no_latin FROM l GROUP BY 1")
def src_lang_dist(spark, sf_dir):
    m = V.memories(spark, sf_dir).select(X.raw_lang(F.col("content")).alias("lang"), F.regexp_count("content", F.lit("[A-Za-z]")).alias("latin"))
    return m.groupBy("lang").agg(F.count("*").alias("n"), F.count(F.when(F.col("latin") == 0, 1)).alias("no_latin"))


@query("SELECT item_id AS q_id, CASE WHEN len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]')) / greatest(len(regexp_extract_all(text, '\\S')), 1) >= 0.15 THEN 'zh' ELSE 'en' END AS lang FROM benchmark")
def query_lang(spark, sf_dir):
    return V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), X.query_lang(F.col("text")).alias("lang"))


@query(f"{MEM}, {tokens_sql('t', 'memories', 'content')} SELECT memory_id, array_to_string(tokens, ' ') AS tokens FROM t")
def raw_tokens(spark, sf_dir):
    return V.memories(spark, sf_dir).select("memory_id", F.array_join(X.raw_tokens(F.col("content")), " ").alias("tokens"))


@query(f"{MEM}, {tokens_sql('t', 'memories', 'content')} SELECT memory_id, array_to_string(summary_tokens, ' ') AS tokens FROM t")
def fts_tokens(spark, sf_dir):
    return V.memories(spark, sf_dir).select("memory_id", F.array_join(F.transform(X.summary_tokens(F.col("content")), F.lower), " ").alias("tokens"))


@query(f"{MEM}, {tokens_sql('t', 'memories', 'content')}, u AS (SELECT memory_id, e FROM t_a) SELECT memory_id, array_to_string(list_filter(e, lambda x, i: list_position(e, x) = i)[1:32], ' ') AS tokens FROM u")
def en_tokens(spark, sf_dir):
    return V.memories(spark, sf_dir).select("memory_id", F.array_join(X.english_tokens(F.col("content")), " ").alias("tokens"))


@query(f"{MEM} SELECT memory_id, array_to_string(core_entities, '|') AS entities FROM memories")
def extract_entities(spark, sf_dir):
    return V.memories(spark, sf_dir).select("memory_id", F.array_join("core_entities", "|").alias("entities"))


@query(f"{MEM} SELECT memory_id, trim(summary || ' ' || array_to_string(core_entities, ' ')) AS text FROM memories")
def candidate_text(spark, sf_dir):
    return V.memories(spark, sf_dir).select("memory_id", F.trim(F.concat_ws(" ", "summary", F.concat_ws(" ", "core_entities"))).alias("text"))


@query(f"{MEM} SELECT memory_id, split_part(summary, ': ', 1) AS role, substring(summary, instr(summary, ': ') + 2) AS text FROM memories")
def split_role(spark, sf_dir):
    return V.memories(spark, sf_dir).select("memory_id", F.substring_index("summary", ": ", 1).alias("role"), F.expr("substring(summary, instr(summary, ': ') + 2)").alias("text"))


@query(f"{MEM} SELECT memory_id, created_at, strftime(source_date, '%Y-%m-%d') AS source_date, time_bucket FROM memories")
def derive_buckets(spark, sf_dir):
    return V.memories(spark, sf_dir).select("memory_id", "created_at", F.date_format("source_date", "yyyy-MM-dd").alias("source_date"), "time_bucket")


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S+00:00') AS iso FROM events")
def norm_ts(spark, sf_dir):
    """The same moments as epochs in seconds, milliseconds and microseconds, by turns of the id."""
    e = V.table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    value = F.when(F.col("event_id") % 3 == 0, F.floor(F.col("us") / 1e6)).when(F.col("event_id") % 3 == 1, F.floor(F.col("us") / 1e3)).otherwise(F.col("us"))
    return e.select("event_id", X.event_time(value, F.lit("now")).alias("iso"))


@query("SELECT 'auto-' || sha1(string_agg(text, '' ORDER BY turn))[1:16] AS user_id, conv_id FROM conversations GROUP BY conv_id")
def derive_user(spark, sf_dir):
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "")
    return V.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.concat(F.lit("auto-"), F.substring(F.sha1(text), 1, 16)).alias("user_id"))


@query("SELECT event_id, json_extract_string(CASE WHEN json_valid(props) THEN props END, '$.k') AS k FROM events")
def json_props(spark, sf_dir):
    return V.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT doc_id, sha256(source || '|' || text) AS hash FROM documents")
def integrity_hash(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat("source", F.lit("|"), "text"), 256).alias("hash"))


@query(f"{MEM} SELECT memory_id, user_id, 'app' AS data_sovereignty, 1.0::DOUBLE AS confidence FROM memories")
def schema_align(spark, sf_dir):
    m = S.schema_align(V.memories(spark, sf_dir), {"data_sovereignty": F.lit("app"), "confidence": F.lit(1.0), "heat": F.lit(9.0)})
    return m.select("memory_id", "user_id", "data_sovereignty", "confidence")


_CACHE = "cache AS (SELECT sha256('hash' || chr(0) || text) AS key, doc_id FROM documents WHERE lang = 'en')"


def _cache(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    return d.filter("lang = 'en'").select(S.vec_cache_key("hash", F.col("text")).alias("key"), "doc_id", "lang")


@query("SELECT doc_id, sha256('hash' || chr(0) || text) AS key FROM documents")
def vec_cache_key(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", S.vec_cache_key("hash", F.col("text")).alias("key"))


@query(f"WITH {_CACHE} SELECT d.doc_id, c.key IS NOT NULL AS cached FROM documents d LEFT JOIN (SELECT DISTINCT key FROM cache) c ON c.key = sha256('hash' || chr(0) || text)")
def vec_cache_get(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select("doc_id", S.vec_cache_key("hash", F.col("text")).alias("key"))
    return d.join(_cache(spark, sf_dir).select("key").distinct().withColumn("hit", F.lit(True)), "key", "left").select("doc_id", F.col("hit").isNotNull().alias("cached"))


@query("WITH k AS (SELECT sha256('hash' || chr(0) || text) AS key, lang FROM documents) SELECT key, CASE WHEN bool_or(lang = 'fr') THEN 'new' ELSE 'old' END AS model FROM k WHERE lang IN ('en', 'fr') GROUP BY key")
def vec_cache_put(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    part = lambda lang, model: d.filter(F.col("lang") == lang).select(S.vec_cache_key("hash", F.col("text")).alias("key"), F.lit(model).alias("model")).distinct()
    return S.vec_cache_put(part("en", "old"), part("fr", "new"))


@query(f"WITH {_CACHE}, t AS (SELECT DISTINCT sha256('hash' || chr(0) || text) AS key FROM documents) SELECT count(*) AS candidates, count(c.key) AS cached, count(*) - count(c.key) AS missing, round(count(c.key) / count(*), 4) AS ratio FROM t LEFT JOIN (SELECT DISTINCT key FROM cache) c USING (key)")
def vec_cache_coverage(spark, sf_dir):
    texts = V.table(spark, sf_dir, "documents").select(S.vec_cache_key("hash", F.col("text")).alias("key"))
    return S.vec_cache_coverage(_cache(spark, sf_dir).select("key").distinct(), texts)


@query(f"WITH {_CACHE} SELECT c.key, c.doc_id FROM cache c WHERE key IN (SELECT sha256('hash' || chr(0) || text) FROM documents WHERE source = 'src1')")
def vec_cache_prune(spark, sf_dir):
    keep = V.table(spark, sf_dir, "documents").filter("source = 'src1'").select(S.vec_cache_key("hash", F.col("text")).alias("key"))
    return S.vec_cache_prune(_cache(spark, sf_dir).select("key", "doc_id"), keep)


@query("SELECT count(*) AS n, count(DISTINCT len(embedding)) AS dims, max(len(embedding)) AS dim, count(DISTINCT 'm' || (label % 3)) AS models, sum(len(embedding) * 4)::BIGINT AS bytes FROM embeddings")
def vec_cache_stats(spark, sf_dir):
    return V.table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"), F.countDistinct(F.size("embedding")).alias("dims"), F.max(F.size("embedding")).alias("dim"), F.countDistinct(F.concat(F.lit("m"), (F.col("label") % 3).cast("string"))).alias("models"), F.sum(F.size("embedding") * 4).alias("bytes"))


@query("SELECT v.vec_id, d.doc_id IS NOT NULL AS found FROM embeddings v LEFT JOIN documents d ON d.doc_id = v.vec_id")
def join_vec(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.lit(True).alias("hit"))
    return V.table(spark, sf_dir, "embeddings").join(d, "vec_id", "left").select("vec_id", F.col("hit").isNotNull().alias("found"))


#: Vault lines of orders, by turns a bad line, an exchange, a text, a summary, no id, no object, and nothing but an id.
_ENTRY = """CASE o_orderkey % 7 WHEN 0 THEN 'not json' WHEN 1 THEN '{"id": "k' || (o_orderkey % 50) || '", "user": "asked ' || o_custkey || '", "assistant": "said ' || o_orderpriority || '"}'
  WHEN 2 THEN '{"entry_id": "k' || (o_orderkey % 50) || '", "text": "plain ' || o_custkey || '", "summary": "s"}' WHEN 3 THEN '{"id": "k' || (o_orderkey % 50) || '", "summary": "short ' || o_custkey || '"}'
  WHEN 4 THEN '{"text": "no id"}' WHEN 5 THEN '[1, 2]' ELSE '{"id": "k' || (o_orderkey % 50) || '"}' END"""
_VAULT_SQL = f"""WITH v AS (SELECT strftime(o_orderdate, '%Y-%m') || '-01' AS date, o_orderkey AS line, {_ENTRY} AS entry FROM orders),
e AS (SELECT *, CASE WHEN json_valid(entry) AND json_type(entry) = 'OBJECT' THEN entry::JSON END AS j FROM v),
f AS (SELECT date, line, coalesce(j->>'id', j->>'entry_id') AS eid, nullif(concat_ws(chr(10), nullif(j->>'user', ''), nullif(j->>'assistant', '')), '') AS orig, nullif(j->>'text', '') AS text, nullif(j->>'summary', '') AS summary FROM e),
g AS (SELECT substring(md5(date || '#' || eid), 1, 12) AS memory_id, date, eid, line, coalesce(orig, text, summary, '') AS source_text, CASE WHEN orig IS NOT NULL THEN 'orig' WHEN text IS NOT NULL THEN 'text' WHEN summary IS NOT NULL THEN 'summary' ELSE 'none' END AS source FROM f WHERE eid IS NOT NULL)"""


def _vault(spark, sf_dir):
    return V.table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-01").alias("date"), F.col("o_orderkey").alias("line"), F.expr(_ENTRY).alias("entry"))


@query(f"{_VAULT_SQL} FROM g QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY line DESC) = 1")
def cold_day_index(spark, sf_dir):
    return S.cold_index(_vault(spark, sf_dir))


@query(f"{_VAULT_SQL} SELECT memory_id, date, line, source_text FROM g WHERE eid IN ('k1', 'k7', 'k13') QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY line) = 1")
def cold_locate(spark, sf_dir):
    """The first line of each wanted entry, day by day."""
    lines = _vault(spark, sf_dir)
    days = lines.select("date").distinct()
    wanted = days.crossJoin(spark.createDataFrame([("k1",), ("k7",), ("k13",)], "eid string")).select(F.substring(F.md5(F.concat_ws("#", "date", "eid")), 1, 12).alias("memory_id"))
    return S.cold_locate(lines, wanted).select("memory_id", "date", "line", "source_text")


@query(f"{_VAULT_SQL} SELECT memory_id, source, count(*) AS n FROM g GROUP BY ALL")
def source_text(spark, sf_dir):
    text, label = S.source_text("e")
    e = F.from_json("entry", "struct<id:string,entry_id:string,user:string,assistant:string,text:string,summary:string>")
    rows = _vault(spark, sf_dir).withColumn("e", e).withColumn("eid", F.coalesce("e.id", "e.entry_id")).filter("eid IS NOT NULL")
    return rows.groupBy(F.substring(F.md5(F.concat_ws("#", "date", "eid")), 1, 12).alias("memory_id"), label.alias("source")).agg(F.count("*").alias("n"))


@query(f"""{_VAULT_SQL}, o AS (SELECT count(*) FILTER (NOT json_valid(entry)) AS bad_lines, count(*) FILTER (json_valid(entry) AND j IS NULL) AS no_objects, count(*) AS scanned, count(DISTINCT date) AS days FROM e)
SELECT scanned, (SELECT count(*) FROM g) AS rows, bad_lines, no_objects, (SELECT count(*) FROM f WHERE eid IS NULL) - bad_lines - no_objects AS no_ids,
  (SELECT count(*) FROM g WHERE source = 'orig') AS orig, (SELECT count(*) FROM g WHERE source = 'text') AS text, (SELECT count(*) FROM g WHERE source = 'summary') AS summary, (SELECT count(*) FROM g WHERE source = 'none') AS no_text,
  (SELECT count(DISTINCT memory_id) FROM g) AS ids, days FROM o""")
def raw_rebuild_stats(spark, sf_dir):
    """What a rebuild from the vault scans, keeps and passes over, in one pass."""
    return S.vault_stats(_vault(spark, sf_dir))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def eval_resume(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id").join(V.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


_ASKED = ["What did Caroline research?", "when did we go?", "did I ever mention Paris", "how do i start the server", "list all the books", "would you say so", "那个呢", "为什么改了", "latest news right now", "these days", "决定用哪个方案 test", "", "is that right?"]


def _asked(spark):
    return spark.createDataFrame(list(enumerate(_ASKED)), "q_id int, q string")


def _case(branches: str, otherwise: str) -> str:
    return f"CASE {branches} ELSE {otherwise} END"


_ASKED_SQL = "a(q_id, q) AS (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(_ASKED)) + ")"
_re = lambda p: p.replace("'", "''")
_CLASS_SQL = _case(" ".join(f"WHEN regexp_matches(q, '{_re(zh)}') OR regexp_matches(lower(q), '{_re(en)}') THEN '{n}'" for n, zh, en in CLASSES), f"'{CLASS_FALLBACK}'")


@query(f"WITH {_ASKED_SQL} SELECT q_id, {_CLASS_SQL} AS class FROM a")
def classify_dim(spark, sf_dir):
    return _asked(spark).select("q_id", X.question_class(F.col("q")).alias("class"))


_POLICY_ROWS = [(n, *CHILD_POLICY.get(n, POLICY[n[0]])) for n, _, _ in CLASSES]


@query(f"WITH {_ASKED_SQL}, p(class, topk, delivery, dedupe) AS (VALUES " + ", ".join(f"('{a}', {b}, '{c}', {str(d).lower()})" for a, b, c, d in _POLICY_ROWS) + f") SELECT q_id, class, topk, delivery, dedupe FROM (SELECT q_id, {_CLASS_SQL} AS class FROM a) JOIN p USING (class)")
def dim_policy(spark, sf_dir):
    policy = spark.createDataFrame(_POLICY_ROWS, "class string, topk int, delivery string, dedupe boolean")
    return _asked(spark).select("q_id", X.question_class(F.col("q")).alias("class")).join(F.broadcast(policy), "class").select("q_id", "class", "topk", "delivery", "dedupe")


@query(f"WITH {_ASKED_SQL} SELECT q_id, CASE WHEN {_CLASS_SQL} = 'B2' THEN 'inference' ELSE 'fact' END AS class FROM a")
def legacy_class(spark, sf_dir):
    return _asked(spark).select("q_id", F.when(X.question_class(F.col("q")) == "B2", "inference").otherwise("fact").alias("class"))


_HITS = {t: " + ".join(f"contains(q, '{k}')::INT" for k in ks) for t, ks in TASK_KEYWORDS.items()}


@query(f"WITH {_ASKED_SQL} SELECT q_id, CASE WHEN length(trim(q)) < 2 OR greatest({', '.join(_HITS.values())}) = 0 THEN NULL " + " ".join(f"WHEN {h} = greatest({', '.join(_HITS.values())}) THEN '{t}'" for t, h in _HITS.items()) + " END AS task_type FROM a")
def task_type_guess(spark, sf_dir):
    return _asked(spark).select("q_id", X.task_type_guess(F.col("q")).alias("task_type"))


_RAW_TYPES = ["决策", "“验证”。", "我觉得是研究", "决策或验证", "", "别的"]
_NAMED = f"list_filter([{', '.join(repr(t) for t in TASK_TYPES)}], lambda x: contains(s, x))"


@query("WITH a(n, s) AS (VALUES " + ", ".join(f"({i}, '{t.strip('“”。')}')" for i, t in enumerate(_RAW_TYPES)) + f") SELECT n, CASE WHEN list_contains([{', '.join(repr(t) for t in [*TASK_TYPES, TASK_FALLBACK])}], s) THEN s WHEN len({_NAMED}) = 1 THEN ({_NAMED})[1] ELSE '{TASK_FALLBACK}' END AS task_type FROM a")
def tasktype_normalize(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(_RAW_TYPES)), "n int, s string").select("n", X.normal_task_type(F.col("s")).alias("task_type"))


@query(f"WITH {_ASKED_SQL} SELECT q_id, regexp_matches(q, '(?i)\\b(latest|most recent|recently|these days|right now|currently|nowadays|last time|as of now)\\b|最新|最近的|最近|目前|现在|当下|上次|这一次|当前') AS recent FROM a")
def recent_query(spark, sf_dir):
    return _asked(spark).select("q_id", X.is_recent(F.col("q")).alias("recent"))


@query("""WITH a AS (SELECT o_orderkey, o_orderkey % 6 AS turn, o_orderdate::DATE AS d FROM orders)
SELECT o_orderkey, CASE turn WHEN 0 THEN d WHEN 1 THEN d WHEN 2 THEN date_trunc('month', d)::DATE WHEN 3 THEN date_trunc('year', d)::DATE WHEN 4 THEN d END AS lo,
  CASE turn WHEN 0 THEN d WHEN 1 THEN d WHEN 2 THEN last_day(d) WHEN 3 THEN make_date(year(d), 12, 31) WHEN 4 THEN d END AS hi,
  CASE turn WHEN 0 THEN 'day' WHEN 1 THEN 'day' WHEN 2 THEN 'month' WHEN 3 THEN 'year' WHEN 4 THEN 'day' END AS kind FROM a""")
def parse_time(spark, sf_dir):
    """Dates in words inside a sentence, written in six ways, one of them none."""
    turn, d = F.col("o_orderkey") % 6, F.to_date("o_orderdate")
    said = F.when(turn == 0, F.date_format(d, "d MMMM yyyy")).when(turn == 1, F.date_format(d, "MMM d, yyyy")).when(turn == 2, F.date_format(d, "MMMM yyyy")).when(turn == 3, F.concat(F.lit("year "), F.year(d).cast("string"))).when(turn == 4, F.date_format(d, "yyyy'年'M'月'd'日'")).otherwise("nothing")
    text = F.concat(F.lit("what was it about, "), said, F.lit("?"))
    return V.table(spark, sf_dir, "orders").select("o_orderkey", X.parse_time(text, F.lit("2023-05-10").cast("date")).alias("t")).select("o_orderkey", "t.lo", "t.hi", "t.kind")


@query("SELECT o_orderkey, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week, strftime(last_day(o_orderdate::DATE), '%Y-%m-%d') AS month_end, strftime(date_trunc('year', o_orderdate), '%Y-%m-%d') AS year FROM orders")
def month_span(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    return o.select("o_orderkey", iso(F.trunc("d", "week")).alias("week"), iso(F.last_day("d")).alias("month_end"), iso(F.trunc("d", "year")).alias("year"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '$' || o_custkey || '|' || (o_orderkey % 90 + 1) || ' days' WHEN 1 THEN '' WHEN 2 THEN (100 + o_custkey) || ' people' ELSE rtrim('university|' || lower(regexp_extract(o_orderpriority, '[A-Z]{4,}')), '|') END AS key_values FROM orders""")
def key_values(spark, sf_dir):
    """Values of sentences with sums and times, small numbers alone, a count, and names."""
    turn, text = F.col("o_orderkey") % 4, lambda c: F.col(c).cast("string")
    name = F.initcap(F.regexp_extract("o_orderpriority", "[A-Z]{4,}", 0))
    said = F.when(turn == 0, F.concat(F.lit("paid $"), text("o_custkey"), F.lit(" in "), (F.col("o_orderkey") % 90 + 1).cast("string"), F.lit(" days")))
    said = said.when(turn == 1, F.lit("about 14 or 17")).when(turn == 2, F.concat((F.col("o_custkey") + 100).cast("string"), F.lit(" people came"))).otherwise(F.concat(F.lit("University "), name))
    return V.table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(X.key_values(said), "|").alias("key_values"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (role <> 'assistant') AS first_slot, string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant') AS second_slot FROM conversations GROUP BY conv_id")
def speaker_split(spark, sf_dir):
    said = lambda who: F.nullif(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(who, F.struct("turn", "text")))), lambda x: x["text"]), "\n"), F.lit(""))
    mine = F.col("role") == "assistant"
    return V.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(said(~mine).alias("first_slot"), said(mine).alias("second_slot"))


@query("SELECT min_date, n FROM (SELECT strftime(min(ts), '%Y-%m-%d') AS min_date, count(*) AS n FROM events WHERE coalesce(props, event_type) <> '')")
def stream_ingest(spark, sf_dir):
    """Events through the stream's merge, as one batch."""
    from ..streaming.ingest import event_messages

    m = event_messages(V.table(spark, sf_dir, "events"))
    return S.upsert(m.limit(0), m, ["heat"]).agg(F.date_format(F.min("source_date"), "yyyy-MM-dd").alias("min_date"), F.count("*").alias("n"))
