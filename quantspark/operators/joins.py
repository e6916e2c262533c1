"""Joins of the research tables: point-in-time, as-of, membership and dimension joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantspark.session import (
    DEFAULT_MAX_BROADCAST_ROWS,
    DEFAULT_PAIRS_PER_TASK,
    MAX_BROADCAST_ROWS,
    PAIRS_PER_TASK,
    fits,
    int_conf,
    written,
)

KEYS = ["symbol", "trade_date"]
#: hot keys that a join tells apart; the hottest come first, so the table of them stays small
MOST_HOT_KEYS = 100_000


def small(df: DataFrame) -> DataFrame:
    """Broadcast ``df`` when a row-limited count shows it is small; otherwise leave it to AQE."""
    limit = int_conf(df.sparkSession, MAX_BROADCAST_ROWS, DEFAULT_MAX_BROADCAST_ROWS)
    return F.broadcast(df) if fits(df, limit) else df


def spread_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner equi-join in which a hot key goes to as many tasks as its pairs need.

    Rows are counted by key on both sides. A key with more than ``quantspark.pairsPerTask`` pairs becomes a grid of cells: its left rows are dealt
    over the rows of the grid and its right rows over the columns, each copied along the other
    direction, and the grid has the shape that copies fewest rows. Every pair meets in exactly one
    cell. Without hot keys it is a plain join. Rows are dealt by the hash of all their columns, so
    equal rows stay together; null keys match nothing; the names ``down_`` and ``across_`` are taken.
    """
    limit = int_conf(left.sparkSession, PAIRS_PER_TASK, DEFAULT_PAIRS_PER_TASK)
    of_left, of_right = (side.groupBy(key).agg(F.count(F.lit(1)).alias(n)) for side, n in ((left, "left_"), (right, "right_")))
    counts = of_left.join(of_right, key)
    cells = F.ceil(F.col("left_").cast("double") * F.col("right_") / limit)
    # n rows and m columns copy left * m + right * n rows: least where n / m is left / right
    rows = F.least(cells, F.greatest(F.lit(1), F.round(F.sqrt(cells * F.col("left_") / F.col("right_")))))
    hot = written(
        counts.where(cells > 1).orderBy(cells.desc(), key).limit(MOST_HOT_KEYS)
        .select(key, rows.cast("int").alias("rows_"), F.ceil(cells / rows).cast("int").alias("columns_"))
    )
    if hot.isEmpty():
        return left.join(right, key)

    def gridded(side: DataFrame, dealt: str, dealt_over: str, copied: str, copied_over: str) -> DataFrame:
        place = F.pmod(F.xxhash64(*side.columns), F.coalesce(dealt_over, F.lit(1)))
        copies = F.sequence(F.lit(0), F.coalesce(copied_over, F.lit(1)) - 1)
        placed = side.join(F.broadcast(hot), key, "left").withColumn(dealt, place.cast("int"))
        return placed.withColumn(copied, F.explode(copies)).drop("rows_", "columns_")

    cut = gridded(left, "down_", "rows_", "across_", "columns_")
    return cut.join(gridded(right, "across_", "columns_", "down_", "rows_"), [key, "down_", "across_"]).drop("down_", "across_")


def attach_filled(bars: DataFrame, basic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Left join on (symbol, trade_date), then carry values forward per symbol."""
    w = Window.partitionBy("symbol").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    joined = bars.join(basic.select(*KEYS, *columns), KEYS, "left")
    return joined.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def attach_optional(bars: DataFrame, other: DataFrame | None, columns: Sequence[str]) -> DataFrame:
    """Left join on (symbol, trade_date); a missing table gives NULL columns."""
    if other is None:
        return bars.withColumns({c: F.lit(None).cast("double") for c in columns})
    return bars.join(other.select(*KEYS, *columns), KEYS, "left")


def attach_metadata(bars: DataFrame, meta: DataFrame, columns: Sequence[str], default="") -> DataFrame:
    joined = bars.join(meta.select("symbol", *columns), "symbol", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(default)) for c in columns})


def newest(df: DataFrame, keys: Sequence[str], order: Column, columns=None) -> DataFrame:
    """One row per key: the one with the greatest ``order``.

    ``max_by`` combines map-side, so any number of copies of one key is harmless.
    """
    rest = [c for c in (columns or df.columns) if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r_"))
    return picked.select(*keys, "r_.*")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_time: str,
    right_time: str,
    columns: Sequence[str],
    *,
    key: str = "symbol",
    strict: bool = False,
    chunk: Column | None = None,
) -> DataFrame:
    """Latest right row at or before (``strict``: before) each left row, per key.

    One union and one window. Ties on the right are settled by the caller (deduplicate
    first). With ``chunk`` - a coarser time bucket of the column ``t_`` - no window holds
    more than one key's chunk: the last right row of the earlier chunks is carried in from
    a per-chunk summary, which keeps hot keys off a single task.
    """
    clash = [c for c in [right_time, *columns] if c in left.columns]
    if clash:
        raise ValueError(f"columns on both sides: {clash}")
    picked = F.struct(F.col(right_time).alias(right_time), *columns)
    lefts = left.withColumns({"t_": F.col(left_time), "side_": F.lit(0 if strict else 1), "left_": F.lit(True)})
    rights = right.where(F.col(right_time).isNotNull()).select(
        key, F.col(right_time).alias("t_"), picked.alias("r_"), F.lit(1 if strict else 0).alias("side_")
    )
    both = lefts.unionByName(rights, allowMissingColumns=True)
    part = [key]
    if chunk is not None:
        both = both.withColumn("chunk_", chunk)
        part.append("chunk_")
    w = Window.partitionBy(*part).orderBy("t_", "side_").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.last("r_", ignorenulls=True).over(w)
    out = both.withColumn("hit_", hit).where("left_")
    if chunk is not None:
        ends = (
            both.where("r_ is not null").groupBy(key, "chunk_").agg(F.max_by("r_", "t_").alias("end_"))
        )
        spine = out.select(key, "chunk_").unionByName(ends.select(key, "chunk_")).distinct()
        before = Window.partitionBy(key).orderBy("chunk_").rowsBetween(Window.unboundedPreceding, -1)
        carried = spine.join(ends, [key, "chunk_"], "left").select(
            key, "chunk_", F.last("end_", ignorenulls=True).over(before).alias("carry_")
        )
        out = out.join(carried, [key, "chunk_"], "left").withColumn("hit_", F.coalesce("hit_", "carry_"))
    return out.select(*left.columns, "hit_.*")


def active_snapshots(dates: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(trade_date, snapshot): the newest snapshot at or before each calendar date.

    Both sides are distinct dates, so the un-partitioned window stays calendar-sized.
    """
    marks = dates.select("trade_date", F.lit(None).cast("date").alias("snap"), F.lit(1).alias("side"))
    snaps = snapshots.select("trade_date", F.col("trade_date").alias("snap"), F.lit(0).alias("side"))
    w = Window.partitionBy(F.lit(0)).orderBy("trade_date", "side").rowsBetween(Window.unboundedPreceding, 0)
    return (
        marks.unionByName(snaps)
        .withColumn("snapshot", F.max("snap").over(w))
        .where("side = 1 and snapshot is not null")
        .select("trade_date", "snapshot")
    )


def membership(panel: DataFrame, index: DataFrame, mode: str = "point_in_time") -> DataFrame:
    """Panel rows whose symbol belongs to the index on that date.

    ``static`` uses the newest snapshot, ``union`` any snapshot, ``point_in_time`` the one
    in force on the date.
    """
    if mode == "union":
        return panel.join(index.select("symbol").distinct(), "symbol", "left_semi")
    if mode == "static":
        last = index.agg(F.max("trade_date")).scalar()
        return panel.join(index.where(F.col("trade_date") == last).select("symbol"), "symbol", "left_semi")
    dates = panel.select("trade_date").distinct()
    active = active_snapshots(dates, index.select("trade_date").distinct())
    members = index.select(F.col("trade_date").alias("snapshot"), "symbol")
    allowed = members.join(F.broadcast(active), "snapshot").select(*KEYS)  # active: one row per day
    return panel.join(allowed, KEYS, "left_semi")


def each_day(spans: DataFrame, days: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """``spans`` with one row per calendar day ``trade_date`` from ``start`` to ``end``, both included.

    Without ``start``, from the first day on; without ``end``, or where it is null, to the last.
    Spans are opened to their dates, which meet the calendar (one row per trading day) by an
    equi-join; a null start has no day.
    """
    first, last = (days.agg(f("trade_date")).scalar() for f in (F.min, F.max))
    begin = first if start is None else F.when(start.isNotNull(), F.greatest(start, first))
    stop = last if end is None else F.least(end, last)
    inside = spans.withColumns({"begin_": begin, "stop_": stop}).where(F.col("begin_") <= F.col("stop_"))
    opened = inside.withColumn("trade_date", F.explode(F.sequence("begin_", "stop_"))).drop("begin_", "stop_")
    return opened.join(F.broadcast(days.select("trade_date")), "trade_date")


def expand_signal(signal: DataFrame, calendar: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Carry each symbol's signal forward, day by day, until its next signal date."""
    w = Window.partitionBy("symbol").orderBy("trade_date")
    spans = signal.select(
        "symbol", F.col("trade_date").alias("from_"), F.lead("trade_date").over(w).alias("until_"), *columns
    )
    out = each_day(spans, calendar, F.col("from_"), F.date_sub("until_", 1))
    return out.select("symbol", "trade_date", *columns)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, label: str) -> DataFrame:
    """One report row: child rows whose key has no parent."""
    parents = parent.select(F.col(parent_key).alias(child_key)).distinct()
    # count child rows per key first so that a hot key is one row in the join
    keyed = child.groupBy(child_key).agg(F.count(F.lit(1)).alias("rows_"))
    lost = keyed.where(F.col(child_key).isNotNull()).join(parents, child_key, "left_anti")
    return lost.agg(F.coalesce(F.sum("rows_"), F.lit(0)).alias("orphan_rows")).select(
        F.lit(label).alias("relation"), F.col("orphan_rows").cast("long")
    )


def mentions(posts: DataFrame, aliases: DataFrame, text: str = "text") -> DataFrame:
    """(doc, symbol) pairs whose upper-cased text contains an alias of three letters or more.

    Filter and verify on equi-joins, so the dictionary may grow without a product of texts
    and aliases: an alias is looked up by its three letters that the fewest distinct words of
    the corpus hold; an alias with a piece in no word cannot occur. An alias without blanks
    lies inside one word, so it is searched in the distinct words of the whole corpus and
    the words are traced back to their texts; the others are searched in the texts that
    share the piece.
    """

    def pieces(text_: Column) -> Column:
        return F.explode(F.array_distinct(F.regexp_extract_all(text_, F.lit("(?s)(?=(.{3}))"), F.lit(1))))

    names = aliases.select("symbol", F.upper("alias").alias("alias_")).where(F.length("alias_") >= 3).distinct()
    names = names.withColumn("blank", F.col("alias_").rlike(r"\s"))
    keyed = names.select("*", pieces(F.col("alias_")).alias("piece"))
    docs = posts.select("doc_id", F.upper(text).alias("u_"))
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split("u_", r"\s+"))).alias("word"))
    wanted = keyed.select("piece").distinct()
    vocabulary = written(docs.select(F.explode(F.split("u_", r"\s+")).alias("word")).distinct())  # has three readers
    vocabulary = vocabulary.select("word", pieces(F.col("word")).alias("piece"))
    vocabulary = vocabulary.join(small(wanted), "piece", "left_semi")
    counts = vocabulary.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    n = F.when(F.col("piece").rlike(r"\s"), F.lit(2**62)).otherwise(F.coalesce("n", F.lit(0)))  # words hold no blank
    rarest = keyed.join(counts, "piece", "left").groupBy("symbol", "alias_", "blank").agg(
        F.min(F.struct(n.alias("n"), "piece")).alias("best")
    ).where("best.n > 0").select("symbol", "alias_", "blank", F.col("best.piece").alias("piece"))
    inside = F.col("word").contains(F.col("alias_"))
    known = vocabulary.join(small(rarest.where("not blank")), "piece").where(inside).select("word", "symbol")
    known = written(known.distinct())
    limit = int_conf(posts.sparkSession, MAX_BROADCAST_ROWS, DEFAULT_MAX_BROADCAST_ROWS)
    # one frequent word may stand in half of all texts
    found = words.join(F.broadcast(known), "word") if fits(known, limit) else spread_join(words, known, "word")
    hit = found.select("doc_id", "symbol")
    spaced = rarest.where("blank")
    if not spaced.limit(1).isEmpty():
        side = docs.select("doc_id", pieces(F.col("u_")).alias("piece")).join(small(spaced), "piece")
        found = side.join(docs, "doc_id").where(F.col("u_").contains(F.col("alias_")))
        hit = hit.unionByName(found.select("doc_id", "symbol"))
    return hit.distinct()


def code_mentions(posts: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, symbol) pairs of the exchange codes written out in the upper-cased text; no join."""
    codes = F.regexp_extract_all(F.upper(text), F.lit(r"\b((?:SH|SZ|BJ)\d{6})\b"), F.lit(1))
    return posts.select("doc_id", F.explode(F.array_distinct(codes)).alias("symbol"))
