"""Near-duplicates by Order MinHash, verified by banded alignment.

A text's shingles of five words are labelled by occurrence, so repeats count. Each of several
rounds hashes them, takes the few smallest and keeps these in text order: texts share such a
sketch when they share shingles in the same order. Texts that share a sketch are candidates.
Short texts also share keys by prefix filtering, by which no similar pair of them is missed.
Candidates are aligned, shingle by shingle, within the band that the wanted similarity leaves.

In every bucket, members are first held against one of them, the one that shares most sketches
overall. What that leaves in different components is then compared across components, so that
large groups of near copies cost one comparison a member, and no candidate link is left out.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspark.llm.common import lists, own_columns, pieces, released, staged, texts_of
from quantspark.llm.components import components
from quantspark.llm.hashing import mixed, stretch_hashes

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: rounds, and labelled shingles of a round's sketch; at similarity 0.8 a pair misses all with odds of 1e-4
ROUNDS = 24
SAMPLED = 5
#: pairs whose shorter text has fewer shingles are all candidates, by prefix keys besides sketches
SHORT = 40
#: shingles that more short texts have than all their shingles over this are joined by broadcast
HOT_SHINGLES = 100_000
#: words hashed at once of a long text
SPAN_WORDS = 1 << 17
#: classes of shingles, a power of two, by which the greatest possible overlap is bounded
CLASSES = 64

_BASE = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(5)
_XORS = _rng.integers(0, 1 << 63, ROUNDS, dtype=np.uint64)
_ODDS = _rng.integers(0, 1 << 63, ROUNDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def span_hashes(words: list[str]) -> np.ndarray:
    """Hashes of all shingles of the words, from sums over the letters of the joined text."""
    raw = np.frombuffer(" ".join(words).encode("utf-8"), np.uint8)
    gaps = np.flatnonzero(raw == 32)
    begin, end = np.concatenate([[0], gaps + 1]), np.append(gaps, len(raw))
    k = min(SHINGLE_WORDS, len(begin))
    return mixed(stretch_hashes(raw, begin[: len(begin) - k + 1], end[k - 1 :]))


def shingles(text: str) -> np.ndarray:
    """A text's shingles, labelled by occurrence, in text order.

    Words are what stands between white space, in lower case. Fewer than five words are one
    shingle; a text without words has none.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    step = SPAN_WORDS
    parts = [span_hashes(words[i : i + step + SHINGLE_WORDS - 1]) for i in range(0, max(1, len(words) - SHINGLE_WORDS + 1), step)]
    h = np.concatenate(parts)
    order = np.argsort(h, kind="stable")
    run = h[order]
    first = np.concatenate([[True], run[1:] != run[:-1]])
    if first.all():
        return h
    start = np.flatnonzero(first)
    nth = np.arange(len(h)) - np.repeat(start, np.diff(np.append(start, len(h))))
    label = np.empty(len(h), np.uint64)
    label[order] = nth
    return np.where(label == 0, h, mixed(h + label * _BASE))


def sketch(h: np.ndarray) -> np.ndarray:
    """One number per round: the round's smallest labelled shingles, in text order."""
    out = np.empty(ROUNDS, np.uint64)
    for r in range(ROUNDS):
        if len(h) > SAMPLED:
            at = np.sort(np.argpartition((h ^ _XORS[r]) * _ODDS[r], SAMPLED)[:SAMPLED])
            chosen = h[at]
        else:
            chosen = h
        acc = np.uint64(len(chosen))
        for x in mixed(chosen ^ _XORS[r]):
            acc = (acc ^ x) * _BASE
            acc ^= acc >> np.uint64(29)
        out[r] = acc
    return out


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Aligned shingles over all shingles of both texts; exact where it reaches ``least``.

    Labelled shingles are unique in a text, so the alignment is the longest run of common ones
    that goes forward in both, among those within the band that ``least`` leaves around the
    diagonal. Below ``least``, the share found so far, which is smaller than ``least`` too.
    """
    na, nb = len(a), len(b)
    need = int(np.ceil(least / (1 + least) * (na + nb) - 1e-9))
    if min(na, nb) < need or not need:
        return 0.0
    common, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(common) < need:
        return len(common) / (na + nb - len(common))
    inside = (ib - ia >= need - na) & (ib - ia <= nb - need)
    ia, ib = ia[inside], ib[inside]
    tails: list[int] = []
    for x in ib[np.argsort(ia)].tolist():
        if not tails or x > tails[-1]:
            tails.append(x)
        else:
            tails[bisect_left(tails, x)] = x
    return len(tails) / (na + nb - len(tails))


def sketches(docs: DataFrame, text_col: str) -> DataFrame:
    """``text_key, n, sketch, few`` of every row: n shingles, few: all of them where prefix keys are due; no shuffle."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in pieces(batches, text_col):
                found = [shingles(t) for t in texts_of(batch, text_col)]
                drawn = [sketch(h).view(np.int64) if len(h) else np.zeros(0, np.int64) for h in found]
                flat = np.concatenate(drawn) if drawn else np.zeros(0, np.int64)
                few = [h.view(np.int64) if len(h) * SIMILARITY < SHORT else np.zeros(0, np.int64) for h in found]
                cols = [batch.column(0), pa.array([len(h) for h in found], pa.int64()), lists(flat, list(map(len, drawn)))]
                yield pa.RecordBatch.from_arrays([*cols, lists(np.concatenate(few), list(map(len, few)))], names=["text_key", "n", "sketch", "few"])

    rows = docs.select(key_of(text_col), text_col)
    return rows.mapInArrow(run, "text_key string, n long, sketch array<long>, few array<long>")


def prefix_keys(nodes: DataFrame) -> DataFrame:
    """``node, n, round, value``: the rarest shingles of each short text, those that another one has.

    Texts of n shingles have ceil(0.8 n) in common with any similar text. In one order of all
    shingles, the least common one is thus among the first n - ceil(0.8 n) + 1 of both texts.
    """
    few = nodes.select("node", "n", F.explode("few").alias("value"))
    often = staged(few.groupBy("value").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") > 1))
    total = nodes.agg(F.sum(F.size("few"))).first()[0] or 0
    hot = F.col("texts") > max(1, total // HOT_SHINGLES)
    frequent = F.broadcast(often.where(hot))
    usual = few.join(frequent.select("value"), "value", "left_anti").join(often.where(~hot), "value")
    shared = usual.unionByName(few.join(frequent, "value")).groupBy("node", "n")
    ordered = shared.agg(F.array_sort(F.collect_list(F.struct("texts", "value"))).alias("shared"))
    # shingles that no other text has are the rarest, and come first
    own = F.col("n") - F.size("shared")
    left = F.col("n") - F.ceil(SIMILARITY * F.col("n") - 1e-9) + 1 - own
    keys = ordered.withColumn("left", left.cast("int")).where(F.col("left") > 0)
    return keys.select("node", "n", F.lit(ROUNDS).alias("round"), F.explode(F.slice("shared.value", F.lit(1), F.col("left"))).alias("value"))


def key_of(text_col: str) -> Column:
    """Equal texts have this in common; null counts as empty."""
    return F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``a, b`` rows of ``pairs`` whose texts align to SIMILARITY or more."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, np.ndarray] = {}  # rows come sorted by b, so its shingles serve again
        with np.errstate(over="ignore"):
            for batch in batches:
                good = []
                for i, (b, ta) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2))):
                    if b not in last:
                        last = {b: shingles(batch.column(3)[i].as_py() or "")}
                    good.append(similarity(shingles(ta.as_py() or ""), last[b]) >= SIMILARITY)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def shared_counts(texts: DataFrame) -> DataFrame:
    """``node, reach``: how many of a text's labelled shingles some other of ``texts`` has, by CLASSES classes."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in pieces(batches, "text"):
                found = [shingles(t) for t in texts_of(batch, "text")]
                flat = np.concatenate(found).view(np.int64)
                by_class = np.concatenate([np.bincount(h % np.uint64(CLASSES), minlength=CLASSES) for h in found])
                cols = [batch.column(0), lists(flat, list(map(len, found))), lists(by_class, [CLASSES] * len(found))]
                yield pa.RecordBatch.from_arrays(cols, names=["node", "found", "counts"])

    rows = staged(texts.select("node", "text").mapInArrow(run, "node long, found array<long>, counts array<long>"))
    once = rows.select("node", F.explode("found").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("texts"), F.min("node").alias("node")).where(F.col("texts") == 1)
    alone = once.groupBy("node", F.col("h").bitwiseAND(F.lit(CLASSES - 1)).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    alone = alone.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("alone"))
    left = F.transform("counts", lambda c, i: c - F.coalesce(F.col("alone")[i.cast("long")], F.lit(0)))
    return rows.drop("found").join(alone, "node", "left").select("node", left.alias("reach"))


def fits(n: Column, m: Column) -> Column:
    """Lengths that similar texts can have."""
    return F.least(n, m) >= SIMILARITY * F.greatest(n, m)


def in_order(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def still_open(inside: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of the buckets whose members are of several components, with ``root`` and ``main``, the largest one."""
    roots = components(links, "a", "b")
    placed = staged(inside.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    parts = placed.groupBy("round", "value", "root").agg(F.count(F.lit(1)).alias("k"))
    split = parts.groupBy("round", "value").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("k", "root")).alias("m")).where(F.col("parts") > 1)
    return staged(placed.join(split.select("round", "value", F.col("m.root").alias("main")), ["round", "value"]))


def across(rows: DataFrame, others: DataFrame, counts: DataFrame, tried: DataFrame) -> DataFrame:
    """Untried ``a, b`` pairs of ``rows`` and ``others`` in one bucket, of different components, that can be similar.

    Two texts align at most, class by class, the fewer of the shingles that each shares with any
    other text; most texts with edits of their own drop out by that.
    """
    of = rows.join(counts, "node")
    names = {"node": "a", "n": "an", "root": "aroot", "reach": "areach"}
    to = of.join(others.select("round", "value", "node"), ["round", "value", "node"], "left_semi").select("round", "value", *[F.col(k).alias(v) for k, v in names.items()])
    most = F.aggregate(F.zip_with("reach", "areach", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda s, x: s + x)
    enough = most >= SIMILARITY / (1 + SIMILARITY) * (F.col("n") + F.col("an")) - 1e-6
    pairs = of.join(to, ["round", "value"]).where((F.col("root") != F.col("aroot")) & fits(F.col("n"), F.col("an")) & enough)
    return staged(pairs.select(*in_order("a", "node")).distinct().join(tried, ["a", "b"], "left_anti"))


def similar_links(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(nodes, links): distinct texts ``text_key, node``, and verified ``a, b`` links between them."""
    every = sketches(docs, text_col).groupBy("text_key").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("few").alias("few"))
    nodes = staged(every.withColumn("node", F.monotonically_increasing_id()))  # fixed once it is written
    rows = nodes.select("node", "n", F.posexplode("sketch").alias("round", "value")).unionByName(prefix_keys(nodes))
    crowded = rows.groupBy("round", "value").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > 1)
    inside = staged(rows.join(crowded, ["round", "value"]))
    shared = inside.groupBy("node").agg(F.sum("members").alias("shared"))
    centres = (
        inside.join(shared, "node")
        .groupBy("round", "value")
        .agg(F.max(F.struct("shared", (-F.col("node")).alias("minus"), "n")).alias("c"))
        .select("round", "value", (-F.col("c.minus")).alias("centre"), F.col("c.n").alias("centre_n"))
    )
    pairs = (
        inside.join(centres, ["round", "value"])
        .where((F.col("node") != F.col("centre")) & fits(F.col("n"), F.col("centre_n")))
        .select(F.col("node").alias("a"), F.col("centre").alias("b"))
        .distinct()
    )
    needed = nodes.select("text_key", "node").join(inside.select("node").distinct(), "node", "left_semi")
    one_each = docs.select(key_of(text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).groupBy("text_key").agg(F.first("text").alias("text"))
    texts = staged(one_each.join(needed, "text_key").select("node", "text"))
    links = staged(verified(pairs, texts).select(*in_order("a", "b")))
    tried = staged(pairs.select(*in_order("a", "b")).distinct())

    open_rows = still_open(inside.join(shared, "node"), links)
    counts = staged(shared_counts(texts.join(open_rows.select("node").distinct(), "node", "left_semi")))
    # a second centre for what the first one left, then every pair across components
    seconds = open_rows.where(F.col("root") != F.col("main")).groupBy("round", "value")
    seconds = seconds.agg(F.max(F.struct("shared", (-F.col("node")).alias("minus"))).alias("c")).select("round", "value", (-F.col("c.minus")).alias("node"))
    more = across(open_rows, open_rows.join(seconds, ["round", "value", "node"], "left_semi"), counts, tried)
    links, tried = staged(links.union(verified(more, texts))), staged(tried.union(more))
    open_rows = still_open(inside.join(shared, "node"), links)
    more = across(open_rows, open_rows.where(F.col("root") != F.col("main")), counts, tried)
    links = links.union(verified(more, texts))
    return nodes.select("text_key", "node"), staged(links.distinct())


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``text_key``, ``class_id``, ``class_rows``, ``n_links``, ``is_first``.

    A class is a component of verified links; equal texts are one class in any case, and null
    counts as an empty text. class_id: the least id in the class, null ids first. n_links: the
    verified links of the row's text to other texts, of which candidate search may leave out
    those inside a class. is_first: the row has the class's least (id, text). Repeated rows
    share a class and all are first if one is. An empty table gives an empty result; other
    columns are not read.
    """
    nodes, links = similar_links(docs, text_col)
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    known = nodes.join(components(links, "a", "b"), "node", "left").join(ends, "node", "left")
    known = known.select("text_key", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    rows = staged(docs.select(id_col, key_of(text_col)).join(known, "text_key"))
    classes = rows.groupBy("root").agg(F.min(F.struct(id_col, "text_key")).alias("least"), F.count(F.lit(1)).alias("class_rows"))
    first = F.struct(id_col, "text_key").eqNullSafe(F.col("least"))
    return rows.join(classes, "root").select(
        id_col, "text_key", F.col(f"least.{id_col}").alias("class_id"), "class_rows", "n_links", first.alias("is_first")
    )


def classes_of_documents(docs: DataFrame) -> DataFrame:
    return near_duplicate_classes(docs).select("doc_id", "class_id", "class_rows", "n_links")


@own_columns
def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: that of the least (id, text); the same columns, whatever their names.

    Null counts as an empty text, null ids come first; of repeated rows one stays; an empty table
    gives an empty result.
    """
    first = near_duplicate_classes(docs).where("is_first").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    rows = docs.withColumn("_text_key", F.md5(F.coalesce(F.col("text"), F.lit(""))))
    kept = rows.join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_text_key"]).select(*docs.columns)
