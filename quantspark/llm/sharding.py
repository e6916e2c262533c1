"""Sharding by balanced label propagation, with DataFrame operations only.

Documents start in a shard drawn from a hash. Documents with equal texts are linked through a
hub. The few largest groups are placed first, whole where a shard has room. In each round every
other hub names the shard that holds most of its documents, less what the shard is over its room;
documents of the hub elsewhere move there, as far as room and departures allow, until the cut no
longer falls. Last, single documents, then whole groups, move from shards above their exact
number to shards below it, so row counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantspark.llm.common import staged

#: rounds in a row without a smaller cut that end the propagation
STALE_ROUNDS = 2
#: a text with more copies than a shard's share over this is placed before the others
HUBS_PER_SHARD = 8
#: copies that a text placed with the others can have in any case, as far as a shard holds them
LEAST_HUB = 32
#: rows that one window numbers, on average
BUCKET_ROWS = 4_000
LEAST_BUCKETS = 128


def share(*seed: Column) -> Column:
    """A number from 0 up to 1 that hashes decide."""
    return F.pmod(F.xxhash64(*seed), F.lit(1 << 30)) / float(1 << 30)


def largest_hub(n: int, shards: int) -> int:
    """Copies of a text beyond which it is hot."""
    return max(1, n // (shards * HUBS_PER_SHARD), min(-(-n // shards), LEAST_HUB))


def linked_rows(docs: DataFrame, shards: int, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Slim rows with ``hub`` (null: no equal text), ``hot`` and a first ``shard``; their number.

    hot: the text has more copies than a fraction of a shard. No more than shards x
    HUBS_PER_SHARD texts can be that frequent, so these are broadcast.
    """
    text = F.col(text_col)
    rows = staged(
        docs.select(
            id_col,
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.coalesce(F.md5(text), F.lit("null")).alias("text_key"),
        )
    )
    n = rows.count()
    most = largest_hub(n, shards)
    copies = staged(rows.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1))
    hot = copies.where(F.col("copies") > most).select("text_key", F.lit(True).alias("hot"))
    usual = copies.where(F.col("copies") <= most).select("text_key", F.lit(True).alias("linked"))
    placed = (
        rows.join(F.broadcast(hot), "text_key", "left")
        .join(usual, "text_key", "left")
        .withColumn("hot", F.coalesce("hot", F.lit(False)))
        .withColumn("hub", F.when(F.col("hot") | F.col("linked"), F.xxhash64("text_key", F.lit(0))))
        .withColumn("shard", F.pmod(F.xxhash64(F.col(id_col), F.col("text_key"), F.lit("shard")), F.lit(shards)).cast("int"))
    )
    return placed.select(id_col, "size", "text_crc32", "text_key", "hub", "hot", "shard"), n


def settled(rows: DataFrame, room: list[int], id_col: str) -> tuple[DataFrame, list[int]]:
    """Hot rows in the shard that their text's counts choose, and the room that is left.

    Copies are counted by text and shard. Largest first, a text goes to the shard that it fills
    best, of these to the one that holds most of it; only a text that no shard has room for is
    split, over as few as can be.
    """
    held: dict[str, dict[int, int]] = {}
    for r in rows.groupBy("text_key", "shard").agg(F.count(F.lit(1)).alias("n")).collect():  # broadcast-sized
        held.setdefault(r["text_key"], {})[r["shard"]] = r["n"]
    room, plan = list(room), []
    for text, own in sorted(held.items(), key=lambda t: (-sum(t[1].values()), t[0])):
        left = copies = sum(own.values())
        while left:
            fits = [s for s in range(len(room)) if room[s] >= left]
            to = min(fits, key=lambda s: (room[s], -own.get(s, 0), s)) if fits else max(range(len(room)), key=lambda s: (room[s], own.get(s, 0), -s))
            part = min(left, room[to])
            room[to] -= part
            left -= part
            plan.append((text, (copies - left) / copies, to))
    if not plan:
        return rows, room
    ends = rows.sparkSession.createDataFrame(plan, "text_key string, end double, to int")
    ends = ends.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("end", "to"))).alias("ends"))
    draw = share(F.col(id_col), F.col("text_key"), F.lit("part"))
    to = F.element_at(F.filter("ends", lambda e: draw < e["end"]), 1)["to"]
    return rows.join(F.broadcast(ends), "text_key").withColumn("shard", to).select(*rows.columns), room


def accepted(flows: list[tuple[int, int, int]], loads: list[int], room: list[int]) -> list[float]:
    """For each shard the part of the rows wanting in that it takes; rows that leave in the same round make room."""
    shards = range(len(room))
    wanted = [sum(n for _, to, n in flows if to == s) for s in shards]
    part = [1.0] * len(room)
    for _ in range(len(room) ** 2):
        leaving = [sum(n * part[to] for of, to, n in flows if of == s) for s in shards]
        part = [min(part[s], max(0.0, room[s] - loads[s] + leaving[s]) / wanted[s]) if wanted[s] else 1.0 for s in shards]
    return part


def propagate(linked: DataFrame, room: list[int], slack: int) -> DataFrame:
    """Moves linked rows towards their hub's best shard, in rounds, until the cut no longer falls.

    The cut is the number of rows outside their hub's best shard. A shard takes rows up to its
    room, what leaves it in the round, and ``slack``, which the row law takes back by whole groups.
    """
    least, stale, turn = None, 0, 0
    full = F.element_at(F.array(*[F.lit(float(max(r, 1))) for r in room]), F.col("shard") + 1)
    while stale < STALE_ROUNDS:
        held = staged(linked.groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n")))
        load = held.groupBy("shard").agg(F.sum("n").alias("load"))  # one row per shard at most
        over = F.greatest(F.col("load") / full - 1, F.lit(0.0))
        totals = held.groupBy("hub").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("parts")).where(F.col("parts") > 1)
        wish = staged(
            held.join(totals, "hub")
            .join(F.broadcast(load), "shard")
            .withColumn("pull", F.col("n") / F.col("total") - over)
            .groupBy("hub")
            .agg(F.max(F.struct("pull", F.xxhash64("hub", "shard", F.lit(turn)).alias("tie"), "shard")).alias("best"))
            .select("hub", F.col("best.shard").alias("to"))
        )
        flows = held.join(wish, "hub").where(F.col("shard") != F.col("to")).groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()  # shards x shards
        cut = sum(r["n"] for r in flows)
        if not cut:
            break
        stale = 0 if least is None or cut < least else stale + 1
        least = cut if least is None else min(cut, least)
        loads = {r["shard"]: r["load"] for r in load.collect()}
        part = accepted([tuple(r) for r in flows], [loads.get(s, 0) for s in range(len(room))], [r + slack for r in room])
        takes = F.element_at(F.array(*map(F.lit, part)), F.col("to") + 1)
        moves = wish.where(share(F.col("hub"), F.lit(turn)) < takes)
        linked = staged(linked.join(moves, "hub", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to").select(*linked.columns))
        turn += 1
    return linked


def numbered(rows: DataFrame, group: list[str], order: list[str], buckets: int, name: str, key: Column | None = None) -> DataFrame:
    """``rows`` with a gapless number from 0 within ``group``, by a hash bucket (of ``key``) and then ``order``.

    Bucket counts are summed first, then each bucket is numbered, so no task holds a group.
    """
    salted = rows.withColumn("bucket", F.pmod(F.xxhash64(*order) if key is None else key, F.lit(buckets)))
    counts = salted.groupBy(*group, "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy(*group, "bucket").orderBy(*order)) - 1
    return salted.withColumn("inside", inside).join(offsets, [*group, "bucket"]).withColumn(name, F.col("offset") + F.col("inside")).drop("bucket", "inside", "offset")


def evened(rows: DataFrame, shards: int, n: int, id_col: str) -> DataFrame:
    """Moves rows from shards above their exact number to shards below it: unlinked rows, then small groups side by side, then hot rows."""
    spark = rows.sparkSession
    every = spark.range(shards).select(F.col("id").cast("int").alias("shard"))
    # of the n % shards shards with one row more, the fullest keep theirs, so fewer rows move
    counts = every.join(rows.groupBy("shard").agg(F.count(F.lit(1)).alias("have")), "shard", "left").fillna(0, ["have"])
    rank = F.row_number().over(Window.orderBy(F.col("have").desc(), "shard"))
    aim = F.lit(n // shards) + (rank <= n % shards).cast("long")
    plan = staged(counts.withColumn("aim", aim).withColumn("over", F.greatest(F.col("have") - F.col("aim"), F.lit(0))).withColumn("under", F.greatest(F.col("aim") - F.col("have"), F.lit(0))))
    until = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    gives = plan.select("shard", "over", F.coalesce(F.sum("over").over(until), F.lit(0)).alias("given"))
    takes = plan.where(F.col("under") > 0).select(F.col("shard").alias("to"), F.coalesce(F.sum("under").over(until), F.lit(0)).alias("from_"), "under")
    buckets = max(LEAST_BUCKETS, n // (shards * BUCKET_ROWS))
    order = ["text_key", id_col, "size"]
    split = rows.withColumn("kind", F.when(F.col("hub").isNull(), 0).when(~F.col("hot"), 1).otherwise(2))
    key = F.when(F.col("kind") == 1, F.xxhash64("text_key")).otherwise(F.xxhash64(*order))
    ranked = numbered(split, ["shard", "kind"], order, buckets, "place", key)
    before = split.groupBy("shard").agg(*[F.count(F.when(F.col("kind") < k, 1)).alias(f"before{k}") for k in (1, 2)])
    lined = (
        ranked.join(F.broadcast(gives), "shard")
        .join(F.broadcast(before), "shard")
        .withColumn("place", F.col("place") + F.when(F.col("kind") == 0, 0).when(F.col("kind") == 1, F.col("before1")).otherwise(F.col("before2")))
        .withColumn("leaves", F.col("place") < F.col("over"))
        .withColumn("turn", F.when(F.col("leaves"), F.col("given") + F.col("place")))
    )
    # one array of the shards that receive, at most as long as there are shards
    ends = takes.agg(F.array_sort(F.collect_list(F.struct((F.col("from_") + F.col("under")).alias("end"), F.col("to")))).alias("ends"))
    bounds = [(r["end"], r["to"]) for r in ends.first()["ends"]]
    to = F.lit(None).cast("int")
    for end, shard in reversed(bounds):
        to = F.when(F.col("turn") < end, F.lit(shard)).otherwise(to)
    return lined.withColumn("shard", F.when(F.col("leaves"), to).otherwise(F.col("shard"))).select(*rows.columns)


def shard_rows(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its ``shard`` and ``slot`` (gapless from 0 in its shard), under the law ``rows``.

    size: UTF-8 bytes of the text (null: none) plus 1. Null texts are equal to one another and
    have no checksum. Repeated rows get slots of their own. Null ids are placed like others; an
    empty table gives an empty result; other columns are not read. Hashes decide all draws, so
    reruns agree.
    """
    rows, n = linked_rows(docs, shards, id_col, text_col)
    rows = staged(rows)
    hot, room = settled(rows.where("hot"), [n // shards + (s < n % shards) for s in range(shards)], id_col)
    moved = propagate(rows.where(F.col("hub").isNotNull() & ~F.col("hot")), room, largest_hub(n, shards))
    even = staged(evened(moved.unionByName(hot).unionByName(rows.where(F.col("hub").isNull())), shards, n, id_col))
    buckets = max(LEAST_BUCKETS, n // (shards * BUCKET_ROWS))
    return numbered(even, ["shard"], [id_col, "size", "text_key"], buckets, "slot")


def shards_of_documents(docs: DataFrame) -> DataFrame:
    return shard_rows(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
