"""Text and sentiment on posts. Term lists are parameters; whole texts are read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspark.operators.joins import newest


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a literal term."""
    return (F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / float(len(term))


def lexicon_score(text: Column, bullish: Sequence[str], bearish: Sequence[str]) -> Column:
    """bull / (bull + bear); NULL when no term occurs."""
    up = sum((occurrences(text, t) for t in bullish), F.lit(0.0))
    down = sum((occurrences(text, t) for t in bearish), F.lit(0.0))
    return F.try_divide(up, F.nullif(up + down, F.lit(0.0)))


def label_of(score: Column) -> Column:
    return F.when(score >= 0.6, "bullish").when(score <= 0.4, "bearish").when(score.isNotNull(), "neutral")


#: accepted spellings of the labels
LABEL_WORDS = {
    "bullish": ("bullish", "positive", "long", "看多"),
    "bearish": ("bearish", "negative", "short", "看空"),
    "neutral": ("neutral", "mixed", "中性"),
}


def normal_label(label: Column, score: Column) -> Column:
    text = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    out = F.when(F.lit(False), "")
    for name, words in LABEL_WORDS.items():
        out = out.when(text.isin(*words), name)
    return out.otherwise(F.coalesce(label_of(score), F.lit("neutral")))


def keywords(text: Column, codes: Column, candidates: Sequence[str], limit: int | None = None) -> Column:
    """Candidate terms present in the text, then the codes; the first ``limit`` of them if given."""
    present = F.filter(F.array(*map(F.lit, candidates)), lambda t: text.contains(t))
    every = F.array_union(present, codes)
    return every if limit is None else F.slice(every, 1, limit)


def assembled_text(title: Column, content: Column, comments_json: Column) -> Column:
    """Title, content and the contents of the nested comments, joined by blanks."""
    comments = F.from_json(comments_json, "array<struct<content:string>>")
    parts = F.concat(
        F.array(title, content),
        F.coalesce(F.transform(comments, lambda c: c["content"]), F.array().cast("array<string>")),
    )
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), " ")


#: the entities that are decoded after tags are gone
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def strip_html(html: Column) -> Column:
    """Text of a page: scripts, styles and tags removed, entities decoded, blanks collapsed."""
    t = F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(t, "<[^>]+>", " ")
    for name, char in ENTITIES.items():
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(t, r"[ \t\r\n]+", " "))


def clean_text(text: Column) -> Column:
    """Inline tags and $symbol$ markers removed."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", "")
    return F.trim(F.regexp_replace(t, r"\$([^$]+)\$", "$1"))


def post_key(tid: Column, title: Column, when: Column) -> Column:
    blank = F.lit("")
    tid = F.trim(F.coalesce(tid.cast("string"), blank))
    spare = F.concat(F.lit("fallback:"), F.trim(F.coalesce(title, blank)), F.lit(":"), F.coalesce(when.cast("string"), blank))
    return F.when(tid != "", F.concat(F.lit("tid:"), tid)).otherwise(spare)


def merge_posts(groups: Sequence[DataFrame], key: str = "key") -> DataFrame:
    """Later groups win; ``first_seen`` keeps the order in which keys first appeared."""
    rows = None
    for i, g in enumerate(groups):
        g = g.withColumn("group_", F.lit(i))
        rows = g if rows is None else rows.unionByName(g)
    payload = [c for c in rows.columns if c not in (key, "group_")]
    return rows.groupBy(key).agg(
        F.max_by(F.struct(*payload), "group_").alias("r"), F.min("group_").alias("first_seen")
    ).select(key, "r.*", "first_seen")


def activity_day(last_reply: Column, published: Column) -> Column:
    return F.to_date(F.coalesce(last_reply, published))


def canonical_source(source: Column, names: Mapping[str, Sequence[str]]) -> Column:
    """Canonical name of a source; unknown sources pass through lower-cased."""
    text = F.lower(F.trim(source))
    out = F.when(F.lit(False), "")
    for name, legacy in names.items():
        out = out.when(text.isin(name, *legacy), name)
    return out.otherwise(text)


def upsert_posts(old: DataFrame, new: DataFrame, names: Mapping[str, Sequence[str]]) -> DataFrame:
    """Newest row per (canonical source, id); counts are never negative."""
    both = old.withColumn("batch_", F.lit(0)).unionByName(new.withColumn("batch_", F.lit(1)))
    both = both.withColumn("source", canonical_source(F.col("source"), names))
    for c in ("reply_count", "like_count"):
        both = both.withColumn(c, F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)))
    return newest(both, ["source", "doc_id"], F.struct("batch_", "reply_count", "like_count")).drop("batch_")


def ranked_posts(posts: DataFrame, symbol: str | None, limit: int) -> DataFrame:
    """Most replied, then most liked, then newest; ``symbol`` looks inside the JSON list."""
    if symbol is not None:
        listed = F.from_json("symbols_json", "array<string>")
        posts = posts.where(F.array_contains(listed, symbol))
    order = [F.desc_nulls_last(c) for c in ("reply_count", "like_count", "published_at")]
    return posts.orderBy(*order, "doc_id").limit(limit)


#: legal-form endings dropped for the short company name (fixed values)
COMPANY_SUFFIXES = ("股份有限公司", "有限责任公司", "有限公司", "集团股份", "集团")


def short_company_name(name: Column) -> Column:
    text = F.trim(name)
    for s in COMPANY_SUFFIXES:
        text = F.replace(text, F.lit(s), F.lit(""))
    return F.nullif(text, F.lit(""))


def aliases(stocks: DataFrame) -> DataFrame:
    """(symbol, alias) rows: code forms, the name and the company's short name."""
    code, suffix = F.split_part("symbol", F.lit("."), F.lit(1)), F.split_part("symbol", F.lit("."), F.lit(2))
    parts = F.array("symbol", code, F.concat(suffix, code), "name", "company_name", short_company_name(F.col("company_name")))
    kept = F.array_distinct(F.filter(F.transform(parts, lambda a: F.trim(a)), lambda a: a.isNotNull() & (a != "")))
    return stocks.select("symbol", F.explode(kept).alias("alias"))


def normal_posts(df: DataFrame, mapping: Mapping[str, Sequence[str]], source: str) -> DataFrame:
    """Raw rows of one source under the post schema; ``mapping`` lists field aliases."""

    def pick(name):
        found = [F.col(c).cast("string") for c in mapping.get(name, ()) if c in df.columns]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    def count(name):
        return F.greatest(F.coalesce(pick(name).try_cast("bigint"), F.lit(0)), F.lit(0))

    return df.select(
        pick("id").alias("post_id"), F.lit(source).alias("source"), clean_text(pick("text")).alias("text"),
        pick("author").alias("author"), pick("time").try_cast("date").alias("published_at"),
        count("replies").alias("reply_count"), count("likes").alias("like_count"),
    ).where("post_id is not null and text <> ''")
