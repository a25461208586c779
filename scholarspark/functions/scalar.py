"""Scalar semantics shared by the operators: missing values, normalisation, tokens, small formulas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[A-Za-z0-9一-鿿]+"

# Expansions of common query terms.
ALIASES = {
    "事件抽取": "event extraction",
    "论元抽取": "argument extraction",
    "触发词": "trigger",
    "小样本": "few-shot",
    "零样本": "zero-shot",
    "文档级": "document-level",
    "跨文档": "cross-document",
    "跨语言": "cross-lingual",
    "低资源": "low-resource",
    "提示学习": "prompt learning",
    "指令微调": "instruction tuning",
    "大模型": "llm",
    "关系抽取": "relation extraction",
}
# Words that mark an affiliation instead of a title.
AFFILIATIONS = ("university", "institute", "laboratory", "department", "school", "college")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def present(c: Column | str, text: bool = True) -> Column:
    """The value unless it is empty text or zero, which count as missing."""
    c = col(c)
    return F.when(c != ("" if text else 0), c)


def first_present(*cols: Column | str) -> Column:
    return F.coalesce(*[present(c) for c in cols])


def round_half_even(c: Column | str, digits: int) -> Column:
    """A double rounded as its binary value says: to the nearest decimal, to the even one only where it lies exactly between.

    The product with the power of ten is taken in two parts, the rounded one and what rounding took (halves of 26 bits
    multiply without loss), so its place beside a half is known exactly. Numbers so large that they have no such digits,
    nulls, NaN and infinities stay; digits from 0 to 15.
    """
    x, scale, split = col(c).cast("double"), F.lit(10.0**digits), F.lit(134217729.0)
    high = lambda v: v * split - (v * split - v)
    p = x * scale
    xh, sh = high(x), high(scale)
    xl, sl = x - xh, scale - sh
    lost = ((xh * sh - p) + xh * sl + xl * sh) + xl * sl
    below = F.floor(p).cast("double")
    beside = (p - below) - F.lit(0.5)
    up = F.when(beside != 0, beside > 0).when(lost != 0, lost > 0).otherwise(F.floor(below / 2) * 2 != below)
    # where the product itself was rounded to a whole number, what it lost tells on which side of it the number is
    return F.when(F.isnan(x) | (F.abs(p) >= F.lit(2.0**52)), x).otherwise((below + F.when(up, 1.0).otherwise(0.0)) / scale)


def normalize_text(c: Column | str) -> Column:
    """Runs of white space one space, trimmed, lower case; null is empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)\s+", " ")))


def tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(normalize_text(c), F.lit(TOKEN), F.lit(0))


def expanded_queries(c: Column | str) -> Column:
    """The same as ``expand_query``, of a column: the query, with translations put in, and the translations, each once."""
    base = F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)\s+", " "))
    inlined = reduce(lambda q, kv: F.replace(q, F.lit(kv[0]), F.when(base.contains(kv[0]), f"{kv[0]} {kv[1]}").otherwise(kv[0])), ALIASES.items(), base)
    found = [F.when(base.contains(k), F.lit(v)) for k, v in ALIASES.items()]
    return F.array_distinct(F.filter(F.array(base, inlined, *found), lambda q: q != ""))


def expand_query(query: str) -> list[str]:
    """The query, the query with each known term followed by its translation, and the translations; first ones win."""
    base = " ".join(query.split())
    found = [(k, v) for k, v in ALIASES.items() if k in base]
    inlined = reduce(lambda q, kv: q.replace(kv[0], f"{kv[0]} {kv[1]}"), found, base)
    return list(dict.fromkeys(q for q in [base, inlined, *[v for _, v in found]] if q))


def contains_cjk(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike("[一-鿿]"), F.lit(False))


def to_metric(c: Column | str) -> Column:
    """A score in percent: fractions are scaled, values over 100 are not scores, three decimals."""
    v = F.expr(f"try_cast({c} AS double)") if isinstance(c, str) else c.try_cast("double")
    return F.when(v > 100, None).when((v > 0) & (v <= 1), F.round(v * 100, 3)).otherwise(F.round(v, 3))


def edge_confidence(source: Column | str, has_doi: Column, title_quality: Column | str) -> Column:
    """Trust in an edge by where it comes from, with small additions for a DOI and a good title match."""
    base = F.when(col(source) == "semantic_scholar", 0.95).when(col(source) == "crossref", 0.85).when(col(source) == "llm_reference", 0.70).otherwise(0.75)
    extra = F.when(has_doi, 0.05).otherwise(0.0) + F.least(F.lit(0.08), 0.08 * F.coalesce(col(title_quality), F.lit(0.0)))
    return F.round(F.greatest(F.lit(0.2), F.least(F.lit(0.99), base + extra)), 4)


def retry_delay(attempts: Column | str, base: int = 600, most: int = 86400) -> Column:
    """Seconds until the next try after one more failure: doubling up to five times."""
    return F.least(F.lit(base) * F.pow(F.lit(2), F.least(col(attempts) + 1, F.lit(5))), F.lit(most)).cast("long")


def next_interval(days: Column | str) -> Column:
    """The spaced-repetition ladder of 1, 3, 7, 14, 30 and 60 days."""
    d = F.coalesce(col(days), F.lit(0))
    out = F.lit(60)
    for low, step in ((30, 30), (14, 14), (7, 7), (3, 3)):
        out = F.when(d < low, step).otherwise(out)
    return F.when(d <= 0, 1).otherwise(out)


def citation_intent(context: Column | str) -> Column:
    """``(intent, confidence)`` of a citing sentence by its cue words; a missing sentence is a weak mention."""
    c = F.lower(F.coalesce(col(context), F.lit("")))
    has = lambda *words: reduce(Column.__or__, [c.contains(w) for w in words])
    kind = F.when(has("baseline", "build on", "following"), "build_on").when(has("however", "limitation", "challenge"), "contrast").when(has("we use", "adopt", "follow"), "use_as_baseline").otherwise("mention")
    sure = F.when(c == "", 0.35).when(kind == "build_on", 0.55).when(kind.isin("contrast", "use_as_baseline"), 0.5).otherwise(0.4)
    return F.struct(kind.alias("intent"), sure.alias("confidence"))


def suspicious_title(c: Column | str) -> Column:
    """Whether a title looks like an address, a link or an affiliation, or is too short to match on."""
    t = F.lower(F.trim(F.coalesce(col(c), F.lit(""))))
    return (F.length(t) < 8) | t.rlike(r"@|http|www|\b(" + "|".join(AFFILIATIONS) + r")\b")


def short_label(c: Column | str, most: int = 36) -> Column:
    t = F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 3), F.lit("..."))).otherwise(t)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine over the shorter length; 0 where a side is empty or zero."""
    a, b = col(a), col(b)
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    add = lambda s, v: s + v
    dot = F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), add)
    norm = lambda z: F.sqrt(F.aggregate(z, F.lit(0.0), lambda s, v: s + v * v))
    return F.coalesce(F.when((norm(x) > 0) & (norm(y) > 0), dot / (norm(x) * norm(y))), F.lit(0.0))


def traceability(avg_score: Column | str, length: Column | str) -> Column:
    """Mean source score scaled down for answers under 80 characters; 0 without sources."""
    factor = F.when(col(length) >= 80, 1.0).otherwise(F.greatest(F.lit(0.4), col(length) / 80))
    return F.coalesce(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(avg_score) * factor)), 4), F.lit(0.0))


def velocity(as_of: int, velocity_col: str = "citation_velocity", count_col: str = "citation_count", year_col: str = "year") -> Column:
    """Citations a year: as reported, else the count over the paper's age."""
    age = F.greatest(F.lit(1), F.lit(as_of) - F.coalesce(F.col(year_col), F.lit(as_of)) + 1)
    return F.coalesce(F.col(velocity_col), F.coalesce(F.col(count_col), F.lit(0)) / age)


def topic_of(sub_field: str = "sub_field", tags: str = "dynamic_tags", keywords: str = "keywords") -> Column:
    """A paper's topic: its field, its first tag, its first keyword, or Unknown."""
    json_first = F.expr(f"try_element_at(from_json({tags}, 'array<string>'), 1)")
    tag = F.when(F.col(tags).startswith("["), json_first).when(F.col(tags).contains(","), F.trim(F.split_part(F.col(tags), F.lit(","), F.lit(1))))
    keyword = F.trim(F.split_part(F.coalesce(F.col(keywords), F.lit("")), F.lit(","), F.lit(1)))
    return F.coalesce(present(sub_field), present(tag), present(keyword), F.lit("Unknown"))


def tag_list(c: Column | str) -> Column:
    """Tags of a JSON list or a comma list: trimmed, first of equal ones ignoring case, 60 characters and 12 tags at most."""
    raw = F.when(col(c).startswith("["), F.from_json(col(c), "array<string>")).otherwise(F.split(col(c), ","))
    clean = F.filter(F.transform(F.coalesce(raw, F.array().cast("array<string>")), lambda t: F.substring(F.trim(t), 1, 60)), lambda t: t != "")
    lower = F.transform(clean, lambda t: F.lower(t))
    return F.slice(F.filter(clean, lambda t, i: F.array_position(lower, F.lower(t)) == i + 1), 1, 12)


def slug(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9一-鿿]+", " "))
