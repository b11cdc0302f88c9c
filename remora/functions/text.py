"""Text and time expressions as Columns; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import CLASS_FALLBACK, CLASSES, ENGLISH_STOP, ENTITY_STOP, MONTH, MONTHS, RECENT, SUMMARY_STOP, TASK_FALLBACK, TASK_KEYWORDS, TASK_TYPES, UNITS

SUMMARY_CAP, ENGLISH_CAP, RAW_CAP, ENTITY_CAP = 24, 32, 48, 8


def words_of(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def folded(text: Column) -> Column:
    """Characters beyond ASCII as "_", so that a word boundary means the same everywhere."""
    return F.regexp_replace(text, "[^\\x00-\\x7F]", "_")


def summary_tokens(text: Column) -> Column:
    """Case-sensitive tokens of the summary index: no stop words, two characters or more, first 24."""
    parts = F.split(F.coalesce(text, F.lit("")), "[^0-9A-Za-z\\u4e00-\\u9fff]+")
    return F.slice(F.filter(F.array_distinct(parts), lambda x: (F.length(x) >= 2) & ~F.lower(x).isin(SUMMARY_STOP)), 1, SUMMARY_CAP)


def english_tokens(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)
    return F.slice(F.filter(F.array_distinct(found), lambda x: (F.length(x) >= 2) & ~x.isin(ENGLISH_STOP)), 1, ENGLISH_CAP)


def raw_tokens(text: Column) -> Column:
    """Tokens of the raw index, lower-cased: both kinds, first 48."""
    return F.slice(F.array_distinct(F.concat(F.transform(summary_tokens(text), F.lower), english_tokens(text))), 1, RAW_CAP)


def raw_lang(text: Column) -> Column:
    cjk = F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[\\u4e00-\\u9fff]"))
    latin = F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[A-Za-z]"))
    share = cjk / F.nullif(cjk + latin, F.lit(0))
    return F.when(share.isNull(), "unk").when(share >= 0.6, "zh").when(share <= 0.1, "en").otherwise("mix")


def query_lang(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    share = F.regexp_count(t, F.lit("[\\u4e00-\\u9fff]")) / F.nullif(F.regexp_count(t, F.lit("\\S")), F.lit(0))
    return F.when(share >= 0.15, "zh").otherwise("en")


def entities(text: Column, cap: int | None = ENTITY_CAP) -> Column:
    """Runs of one or two capitalised words, in order, each once; all of them without a cap."""
    found = F.regexp_extract_all(folded(F.coalesce(text, F.lit(""))), F.lit("\\b([A-Z][a-z]{2,}(?:\\s+[A-Z][a-z]{2,})?)\\b"), 1)
    stop = words_of(ENTITY_STOP)
    names = F.array_distinct(F.filter(found, lambda x: ~F.array_contains(stop, F.lower(x))))
    return names if cap is None else F.slice(names, 1, cap)


def memory_id(user: Column, session: Column, created: Column, idx: Column, content: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("#", user, session, created, idx.cast("string"), content)), 1, 12)


def event_time(value: Column, now: Column) -> Column:
    """ISO text of an epoch in s, ms or µs, of known formats, or of now; ISO text stays as it is."""
    v = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    n = F.when(v.rlike("^\\d+(\\.\\d+)?$"), v.cast("double"))
    seconds = n
    for _ in range(4):
        seconds = F.when(seconds > 1e11, seconds / 1000).otherwise(seconds)
    iso = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    out = F.when(v == "", now).when(n.isNotNull(), iso(F.timestamp_seconds(F.floor(seconds)))).when(v.rlike("^\\d{4}-\\d{2}-\\d{2}T"), v)
    for shape in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm", "yyyy-MM-dd"):
        out = F.coalesce(out, iso(F.try_to_timestamp(v, F.lit(shape))))
    return F.coalesce(out, now)


def is_recent(query: Column) -> Column:
    return folded_keep_cjk(query).rlike(RECENT)


def folded_keep_cjk(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\u0080-\\u2FFF]", "_")


def interpreted(value: Column, f) -> Column:
    """f of value, evaluated inside a higher-order function: for expressions too long for generated code."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def question_class(query: Column) -> Column:
    return interpreted(folded_keep_cjk(query), _question_class)


def _question_class(q: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, zh, en in CLASSES:
        out = F.coalesce(out, F.when(q.rlike(zh) | F.lower(q).rlike(en), name))
    return F.coalesce(out, F.lit(CLASS_FALLBACK))


def task_type_guess(query: Column) -> Column:
    return interpreted(F.coalesce(query, F.lit("")), _task_type_guess)


def _task_type_guess(q: Column) -> Column:
    hits = {t: sum((F.when(q.contains(k), 1).otherwise(0) for k in ks), F.lit(0)) for t, ks in TASK_KEYWORDS.items()}
    best = F.greatest(*hits.values())
    out = F.lit(None).cast("string")
    for t, n in hits.items():
        out = F.coalesce(out, F.when((n == best) & (best > 0), t))
    return F.when(F.length(F.trim(q)) >= 2, out)


def normal_task_type(raw: Column) -> Column:
    """A known type, or the only one that the text names, or the fallback."""
    s = F.regexp_replace(F.coalesce(raw, F.lit("")), "^[\"'`“”‘’。，,：: \\n\\t]+|[\"'`“”‘’。，,：: \\n\\t]+$", "")
    every = words_of([*TASK_TYPES, TASK_FALLBACK])
    named = F.filter(words_of(TASK_TYPES), lambda x: F.contains(s, x))
    return F.when(F.array_contains(every, s), s).when(F.size(named) == 1, F.get(named, F.lit(0))).otherwise(TASK_FALLBACK)


def key_values(text: Column) -> Column:
    """Up to five values that an answer must hold: numbers with units, or else proper names."""
    t = folded(F.coalesce(text, F.lit("")))
    raw = F.regexp_extract_all(t, F.lit(f"(?i)\\$?\\d[\\d,]*(?:\\.\\d+)?\\s*(?:{UNITS})?\\b"), 0)
    value = F.transform(raw, lambda x: F.lower(F.trim(F.regexp_replace(x, "\\s+", " "))))
    keep = F.filter(value, lambda x: x.rlike("[a-z%$]") | (F.length(F.regexp_replace(x, "[^0-9]", "")) >= 3))
    names = F.filter(F.regexp_extract_all(t, F.lit("\\b([A-Z][a-z]{3,})\\b"), 1), lambda x: ~F.lower(x).isin("none", "and", "the", "that", "this", "with", "your", "you", "would", "prefer", "preferred", "information", "available"))
    return F.slice(F.array_distinct(F.when(F.size(keep) > 0, keep).otherwise(F.transform(names, F.lower))), 1, 5)


def query_bigrams(query: Column, cap: int = 8) -> Column:
    """Names that a query may hold where no segmenter is at hand: its character pairs."""
    q = F.coalesce(query, F.lit(""))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(q) - 1, F.lit(1))), lambda i: F.trim(F.substring(q, i, F.lit(2))))
    return F.when(F.length(F.trim(q)) < 2, F.array().cast("array<string>")).otherwise(F.slice(F.array_distinct(F.filter(pairs, lambda x: (F.length(x) >= 2) & ~x.rlike("^[0-9]+$"))), 1, cap))


def absent_values(delivered: Column, history: Column, values: Column, most: int = 5) -> Column:
    """Values that should have been delivered and were not: none unless all that tell apart are missing."""
    known = F.filter(values, lambda v: (F.length(history) - F.length(F.replace(history, v, F.lit("")))) / F.length(v) <= most)
    missing = F.filter(known, lambda v: ~F.contains(delivered, v))
    return F.when(F.size(missing) < F.size(known), F.array().cast("array<string>")).otherwise(missing)


def hash_vector(text: Column, dims: int = 32) -> Column:
    """Values in [-1, 1) from the text's SHA-256."""
    # the digest is bound once, not computed anew for each value
    values = lambda h: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: (F.conv(F.substring(h, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") - 128) / 128)
    return interpreted(F.sha2(F.coalesce(text, F.lit("")), 256), values)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def month_number(name: Column) -> Column:
    low = F.substring(F.lower(name), 1, 3)
    out = F.lit(None).cast("int")
    for i, m in enumerate(MONTHS, 1):
        out = F.when(low == m[:3], i).otherwise(out)
    return out


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")


def _interval(lo: Column, hi: Column, kind: str, ok: Column) -> Column:
    return F.when(ok, F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(kind).alias("kind")))


def parse_time(query: Column, anchor: Column) -> Column:
    """The closed interval of dates that a query names, by a cascade from exact to broad; null without one.

    anchor is the date that relative words refer to; with a null one they name an interval without ends.
    The cascade is too long for generated code, so it is interpreted, inside a higher-order function.
    """
    return interpreted(F.struct(query.alias("q"), anchor.alias("a")), lambda x: _time_cascade(x["q"], x["a"]))


def _time_cascade(query: Column, anchor: Column) -> Column:
    q = F.regexp_replace(F.coalesce(query, F.lit("")), "[\\u0080-\\u2FFF]", "_")
    part = lambda p, i: F.regexp_extract(q, p, i)
    num = lambda p, i: F.nullif(part(p, i), F.lit("")).cast("int")
    day_of = lambda y, m, d: (lambda x: _interval(x, x, "day", x.isNotNull()))(_date(y, m, d))
    month_of = lambda y, m: (lambda x: _interval(x, F.last_day(x), "month", x.isNotNull()))(_date(y, m, F.lit(1)))
    year_of = lambda y: _interval(_date(y, F.lit(1), F.lit(1)), _date(y, F.lit(12), F.lit(31)), "year", y.isNotNull())
    ymd = "(\\d{4})\\s*年\\s*(\\d{1,2})\\s*月\\s*(\\d{1,2})\\s*[日号]"
    iso = "\\b(\\d{4})-(\\d{1,2})(?:-(\\d{1,2}))?\\b"
    dmy = f"(?i)\\b(\\d{{1,2}})(?:st|nd|rd|th)?\\s+({MONTH})\\.?,?\\s+(\\d{{4}})\\b"
    mdy = f"(?i)\\b({MONTH})\\.?\\s+(\\d{{1,2}})(?:st|nd|rd|th)?,?\\s+(\\d{{4}})\\b"
    my = f"(?i)\\b({MONTH})\\.?,?\\s+(\\d{{4}})\\b"
    ym, md = "(\\d{4})\\s*年\\s*(\\d{1,2})\\s*月", "(\\d{1,2})\\s*月\\s*(\\d{1,2})\\s*[日号]"
    rel = "(?i)\\b(yesterday|today|tomorrow|tonight|(?:last|this|next)\\s+(?:week|month|year)|last\\s+night|\\d+\\s+(?:day|week|month|year)s?\\s+ago)\\b"
    year = F.year(anchor)
    r = F.regexp_replace(F.lower(part(rel, 1)), "\\s+", " ")
    back = F.regexp_extract(r, "^(\\d+) ", 1)
    sign = F.when(r.rlike("^(last|yesterday|\\d)"), -1).when(r.rlike("^(next|tomorrow)"), 1).otherwise(0)
    steps = F.when(back != "", back.cast("int") * -1).otherwise(sign)
    cn_word = part("(昨天|今天|明天|前天|后天|上周|上个月|上月|去年|今年|明年|最近)", 1)
    cn_steps = F.when(cn_word.isin("昨天", "上周", "上个月", "上月", "去年", "最近"), -1).when(cn_word.isin("明天", "明年"), 1).when(cn_word == "前天", -2).when(cn_word == "后天", 2).otherwise(0)
    cn_unit = F.when(cn_word.isin("上周", "最近"), "week").when(cn_word.isin("上个月", "上月"), "month").when(cn_word.isin("去年", "今年", "明年"), "year").otherwise("day")
    unit = F.when(r.rlike("week"), "week").when(r.rlike("month"), "month").when(r.rlike("year"), "year").otherwise("day")

    def relative(unit: Column, n: Column) -> Column:
        day = F.date_add(anchor, n)
        week = F.date_add(F.trunc(anchor, "week"), n * 7)
        month = F.add_months(F.trunc(anchor, "month"), n)
        lo = F.when(unit == "day", day).when(unit == "week", week).when(unit == "month", month).otherwise(F.add_months(F.trunc(anchor, "year"), n * 12))
        hi = F.when(unit == "day", day).when(unit == "week", F.date_add(week, 6)).when(unit == "month", F.last_day(month)).otherwise(F.date_add(F.add_months(F.trunc(anchor, "year"), n * 12 + 12), -1))
        return F.struct(lo.alias("lo"), hi.alias("hi"), F.when(anchor.isNull(), "relative").otherwise(unit).alias("kind"))

    none = F.struct(F.lit(None).cast("date").alias("lo"), F.lit(None).cast("date").alias("hi"), F.lit("relative").alias("kind"))
    bare = f"(?i)\\b({MONTH})\\b"
    return F.coalesce(
        day_of(num(ymd, 1), num(ymd, 2), num(ymd, 3)),
        day_of(num(iso, 1), num(iso, 2), num(iso, 3)),
        month_of(num(iso, 1), num(iso, 2)),
        day_of(num(dmy, 3), month_number(part(dmy, 2)), num(dmy, 1)),
        day_of(num(mdy, 3), month_number(part(mdy, 1)), num(mdy, 2)),
        month_of(num(ym, 1), num(ym, 2)),
        day_of(F.when(part(md, 0) != "", year), num(md, 1), num(md, 2)),
        F.when(part(md, 0) != "", none),
        month_of(num(my, 2), month_number(part(my, 1))),
        F.when(part(rel, 0) != "", relative(unit, steps)),
        F.when(cn_word != "", relative(cn_unit, cn_steps)),
        month_of(F.when(part("(?<!\\d)(\\d{1,2})\\s*月(?!\\s*\\d)", 0) != "", year), num("(?<!\\d)(\\d{1,2})\\s*月(?!\\s*\\d)", 1)),
        month_of(F.when(part(bare, 0) != "", year), month_number(part(bare, 1))),
        year_of(num("(\\d{4})\\s*年", 1)),
        year_of(num("\\b(1[6-9]\\d{2}|20\\d{2})\\b", 1)),
    )
