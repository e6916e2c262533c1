"""Mixing sources to target weights, with DataFrame operations only.

Each source's words are packed, document after document, into blocks of fixed length. The output
has as many slots as the targets ask for blocks, in shards of equal length. Every slot of a shard
draws a source with the share of its target, which makes a shard's counts by source a multinomial
draw. Sources that were drawn too often give the surplus back, in proportion over the shards, and
those drawn too seldom take the slots left free, so that every source meets its target and every
shard keeps its length. A source's slots, numbered over the shards, make passes over its blocks;
within a pass a slot maps to a block through a keyed permutation of the block indexes, and slots
are joined to blocks by index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantspark.llm.common import own_columns, staged

#: words of a block; a source's take is within half a block of its target
BLOCK_WORDS = 64
#: passes over a source at most, and so the copies of a document at most
MOST_PASSES = 3
#: weights of the sources in their order, repeating
WEIGHTS = (1, 2, 3)
#: documents of one source that one window sorts, on average
BUCKET_ROWS = 4_000
LEAST_BUCKETS = 256
SHARDS = 64
#: rounds of the index permutations
ROUNDS = 32
#: ranges of the slots, at least, by which a draw finds its source
LEAST_RANGES = 1_024
#: slots that one row is opened to
CHUNK = 4_096
#: slots that one task draws, and slots that one task opens, on average at most
TASK_SLOTS = 20_000_000
OPEN_SLOTS = 500_000
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


def sized(docs: DataFrame, source_col: str, text_col: str) -> DataFrame:
    """``docs`` with ``size``, its number of words (null: 0), and a hash that places it in its source."""
    return docs.withColumns({
        "size": F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)).cast("long"), F.lit(0).cast("long")),
        "source_key": F.struct(F.col(source_col).isNull().alias("none"), F.coalesce(F.col(source_col), F.lit("")).alias("name")),
    })


def running(df: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each name, the sum of its column over all rows that come before in ``order``.

    Rows are laid out by ranges of the order. Ranges are summed first, then the rows of each, so
    the only window without a key sees one row per shuffle partition.
    """
    laid = staged(df.repartitionByRange(*order).withColumn("lay_", F.spark_partition_id()))
    ahead = Window.orderBy("lay_").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("lay_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    of_lay = laid.groupBy("lay_").agg(*[F.sum(c).alias(f"{n}_lay_") for n, c in sums.items()])
    offsets = of_lay.select("lay_", *[F.coalesce(F.sum(f"{n}_lay_").over(ahead), zero).alias(f"{n}_lay_") for n in sums])
    with_sums = laid.withColumns({n: F.coalesce(F.sum(c).over(inside), zero) for n, c in sums.items()})
    joined = with_sums.join(F.broadcast(offsets), "lay_")  # a row per shuffle partition
    return joined.withColumns({n: F.col(n) + F.col(f"{n}_lay_") for n in sums}).drop("lay_", *[f"{n}_lay_" for n in sums])


def targets(sizes: DataFrame) -> DataFrame:
    """``source_key, source_size, target``: one row per source.

    The level is the one at which weight times level, stopped at MOST_PASSES times the size,
    adds up to all sizes. Sources that stop come first in the order of stop over weight. Totals
    and the level, three numbers, pass through the driver.
    """
    by_source = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int")).cast("long")
    weighed = (
        running(by_source, ["source_key"], {"place": F.lit(1).cast("long")})
        .withColumn("weight", weight)
        .withColumn("stop", F.col("source_size") * MOST_PASSES)
        .withColumn("ratio", F.col("stop") / F.col("weight"))
    )
    by_stop = running(weighed, ["ratio", "source_key"], {"stopped": F.col("stop"), "gone": F.col("weight")})
    whole = by_stop.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(whole["size"]) - F.col("stopped")) / (F.lit(whole["weight"]) - F.col("gone"))
    free = by_stop.withColumn("level", level).where(F.col("level") <= F.col("ratio"))
    found = free.agg(F.min_by("level", F.struct("ratio", "source_key"))).first()[0]
    share = F.col("weight") * F.lit(0.0 if found is None else found)
    return by_stop.select("source_key", "source_size", F.least(share, F.col("stop").cast("double")).alias("target"))


def packed(rows: DataFrame, sources: DataFrame, id_col: str) -> DataFrame:
    """``rows`` with ``start``, the words of its source before it, and ``source_size`` and ``target``.

    The order within a source is by a hash bucket of the id, then id and size. Sums of buckets
    come first, then sums inside each bucket, so no task holds a whole source; rows meet what is
    known of their source by source and bucket.
    """
    n = rows.count()
    buckets = max(LEAST_BUCKETS, n // BUCKET_ROWS)
    salted = rows.withColumn("bucket", F.pmod(F.xxhash64(F.col(id_col), F.col("text_key")), F.lit(buckets)))
    sums = salted.groupBy("source_key", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source_key", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source_key", "bucket").orderBy(id_col, "size", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    return (
        salted.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets.join(sources.select("source_key", "source_size", "target"), "source_key"), ["source_key", "bucket"])
        .withColumn("start", F.col("offset") + F.col("inside"))
        .drop("bucket", "inside", "offset")
    )


def wanted(sources: DataFrame) -> DataFrame:
    """Adds ``full`` blocks, ``blocks`` with a shorter last one, full ``passes``, the full blocks ``rest``
    of the last, partial pass, and ``slots``, the blocks that all passes take."""
    left = F.col("target") - F.col("passes") * F.col("source_size")
    tail = F.col("source_size") % BLOCK_WORDS
    tail_too = (tail > 0) & (left - F.col("rest") * BLOCK_WORDS >= tail / 2)
    return (
        sources.withColumn("full", F.floor(F.col("source_size") / BLOCK_WORDS))
        .withColumn("blocks", F.col("full") + (tail > 0).cast("long"))
        .withColumn("passes", F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))))
        .withColumn("rest", F.least(F.round(left / BLOCK_WORDS).cast("long"), F.col("full")))
        .withColumn("slots", F.col("passes") * F.col("blocks") + F.col("rest") + tail_too.cast("long"))
    )


def drawn(sources: DataFrame, slots: int, shards: int) -> DataFrame:
    """``shard, source_key, n``: a multinomial draw for every shard, each slot drawing on its own.

    ``sources`` holds ``slots`` and, before them, the sum ``ahead`` of the slots of other sources:
    a draw is a number below all slots, and its source the one whose slots hold that number. It
    is found by ranges of numbers, about as many as there are sources.
    """
    spark = sources.sparkSession
    width = max(1, slots // max(LEAST_RANGES, sources.count()))
    of_shard = -(-slots // shards)
    end = F.col("ahead") + F.col("slots")
    ranges = sources.where("slots > 0").select(
        "source_key", "ahead", end.alias("end"), F.explode(F.sequence(F.floor(F.col("ahead") / width), F.floor((end - 1) / width))).alias("range")
    )
    tasks = max(spark.sparkContext.defaultParallelism, slots // TASK_SLOTS + 1)
    number = F.pmod(F.xxhash64(F.lit("draw"), "id"), F.lit(slots))
    draws = spark.range(0, slots, 1, tasks).select(F.expr(f"id div {of_shard}").cast("int").alias("shard"), number.alias("number"))
    draws = draws.withColumn("range", F.floor(F.col("number") / width))
    hit = draws.join(staged(ranges), "range").where((F.col("number") >= F.col("ahead")) & (F.col("number") < F.col("end")))
    return hit.groupBy("shard", "source_key").agg(F.count(F.lit(1)).alias("n"))


def settled(draws: DataFrame, sources: DataFrame, shards: int) -> DataFrame:
    """``shard, source_key, n`` after the exchange: shards are as long as before, sources have their ``slots``.

    A source drawn too often gives back its surplus in proportion to its draws so far. The free
    slots are numbered by shard, the missing ones by source, and equal numbers meet; the number
    of free slots before each shard, one number a shard, passes through the driver.
    """
    upto = Window.partitionBy("source_key").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy("source_key")
    counted = (
        draws.join(sources.select("source_key", "slots"), "source_key")
        .withColumn("upto", F.sum("n").over(upto))
        .withColumn("drawn", F.sum("n").over(own))
        .withColumn("surplus", F.greatest(F.col("drawn") - F.col("slots"), F.lit(0)))
    )
    back = F.expr("upto * surplus div drawn - (upto - n) * surplus div drawn")
    kept = staged(counted.select("shard", "source_key", (F.col("n") - back).alias("n"), back.alias("back"), "drawn"))
    free = {r.shard: r.back for r in kept.groupBy("shard").agg(F.sum("back").alias("back")).collect()}  # a row a shard
    bounds = [0]
    for shard in range(shards):
        bounds.append(bounds[-1] + free.get(shard, 0))
    have = kept.groupBy("source_key").agg(F.max("drawn").alias("drawn"))
    short = sources.select("source_key", "slots").join(have, "source_key", "left").withColumn("short", F.col("slots") - F.coalesce("drawn", F.lit(0)))
    missing = running(short.where("short > 0"), ["source_key"], {"before": F.col("short")})
    begin = F.array(*map(F.lit, bounds[:-1]))
    end = F.array(*map(F.lit, bounds[1:]))
    of_shard = F.zip_with(begin, end, lambda b, e: F.greatest(F.least(F.col("before") + F.col("short"), e) - F.greatest(F.col("before"), b), F.lit(0)))
    added = missing.select("source_key", F.posexplode(of_shard).alias("shard", "n")).where("n > 0")
    both = kept.select("shard", "source_key", "n").unionByName(added.select("shard", "source_key", "n"))
    return both.groupBy("shard", "source_key").agg(F.sum("n").alias("n")).where("n > 0")


def permuted(index: Column, n: Column, key: Column) -> Column:
    """A permutation of 0..n-1 for every ``key``, whatever n: the swap-or-not shuffle.

    A round pairs each index with the one at the round's distance from it, and a hash of the
    larger of the two decides whether both change places.
    """

    def turn(at: Column, distance: Column) -> Column:
        other = F.pmod(distance - at, n)
        return F.when(F.xxhash64(distance, F.greatest(at, other)) % 2 == 0, other).otherwise(at)

    distances = F.transform(F.sequence(F.lit(1), F.lit(ROUNDS)), lambda i: F.shiftrightunsigned(F.xxhash64(key, i), 1))
    return F.aggregate(distances, index, turn)


def slots_of(sources: DataFrame, shards: int) -> DataFrame:
    """``shard, source_key, epoch, block``: every slot of the output with the block that fills it."""
    numbered = staged(running(sources, ["source_key"], {"ahead": F.col("slots")}))
    slots = numbered.agg(F.sum("slots")).first()[0] or 0
    draws = drawn(numbered, max(slots, 1), shards)
    counts = settled(staged(draws), numbered, shards).join(numbered.select("source_key", "full", "blocks", "passes", "rest"), "source_key")
    before = Window.partitionBy("source_key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    chunks = (
        counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("end", F.col("first") + F.col("n"))
        .withColumn("from", F.explode(F.sequence(F.col("first"), F.col("end") - 1, F.lit(CHUNK).cast("long"))))
        .repartition(max(sources.sparkSession.sparkContext.defaultParallelism, slots // OPEN_SLOTS + 1), "source_key", "shard", "from")
    )
    opened = (
        chunks.withColumn("slot", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + CHUNK, F.col("end")) - 1)))
        .withColumn("epoch", F.expr("slot div blocks"))
        .withColumn("index", F.col("slot") % F.col("blocks"))
        .withColumn("key", F.xxhash64("source_key", "epoch"))
    )
    in_pass = F.when(F.col("epoch") < F.col("passes"), F.col("full")).otherwise(F.col("rest"))
    # the last block, shorter than the others, stands for itself
    block = F.when(F.col("index") < in_pass, permuted(F.col("index"), F.col("full"), F.col("key"))).otherwise(F.col("full"))
    return opened.select("shard", "source_key", "epoch", block.alias("block"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces) of the mix.

    documents: id, ``source_key``, ``text_key``, ``size``, ``source_size``, ``target``, ``start``.
    pieces: ``shard, source_key, epoch, block, start, skip, words``: what one drawn block, in output
    shard ``shard``, takes of the document that starts at ``start`` in its source, ``words`` words
    after the first ``skip``.

    Null texts have size 0 and are never taken; a null source is a source of its own, ordered
    last; repeated rows are packed each; empty tables give empty results; other columns are not
    read. Draws depend on ids, texts and sources alone, so reruns agree.
    """
    slim = sized(docs.select(id_col, source_col, text_col), source_col, text_col)
    rows = staged(slim.select(id_col, "source_key", F.md5(F.col(text_col)).alias("text_key"), "size"))
    sources = staged(wanted(targets(rows)))
    documents = staged(packed(rows, sources, id_col))
    first, last = F.floor(F.col("start") / BLOCK_WORDS), F.floor((F.col("start") + F.col("size") - 1) / BLOCK_WORDS)
    parts = documents.where(F.col("size") > 0).select("source_key", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("start"), F.col("block") * BLOCK_WORDS)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK_WORDS)
    parts = parts.select("source_key", "block", "start", (begin - F.col("start")).alias("skip"), (end - begin).alias("words"))
    # slots come out of few rows, from which their size cannot be told: both sides are sorted
    found = slots_of(sources, shards).hint("merge").join(parts, ["source_key", "block"])
    return documents, found.select("shard", "source_key", "epoch", "block", "start", "skip", "words")


def mix_of_documents(docs: DataFrame) -> DataFrame:
    """The digest of a mix: words taken per document, and the number of output shards that hold some of them."""
    documents, found = mix(docs)
    taken = found.groupBy("source_key", "start").agg(F.sum("words").alias("taken"), F.size(F.collect_set("shard")).alias("n_shards"))
    own = documents.select("doc_id", "source_key", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("start")).alias("start"))
    return own.join(taken, ["source_key", "start"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        F.coalesce("n_shards", F.lit(0)).cast("long").alias("n_shards"),
    )


@own_columns
def mixed_texts(docs: DataFrame) -> DataFrame:
    """The mix as documents, with the columns of ``docs``, whatever their names: one row for each pass over a document.

    A pass that takes every word keeps the text as it is; another holds the words it takes, in
    their order, joined by one blank. Documents without words, null texts among them, cannot be
    taken; repeated rows are taken each; a null source is a source of its own; an empty table gives
    an empty result.
    """
    rows = docs.withColumn("text_key", F.md5("text"))
    documents, found = mix(docs)
    takes = found.groupBy("source_key", "start", "epoch").agg(
        F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("skip", "words"))).alias("parts")
    )
    # equal rows (id, text, source) stand at several starts: the rank among them tells them apart
    same = Window.partitionBy("doc_id", "source_key", "text_key").orderBy("start")
    placed = documents.select("doc_id", "source_key", "text_key", "start", "size", F.row_number().over(same).alias("copy"))
    further = F.to_json(F.struct(*[c for c in docs.columns if c != "text"]))  # equal ones are the same row
    of_rows = sized(rows, "source", "text").drop("size").withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "source_key", "text_key").orderBy(further)))
    ids = ["doc_id", "source_key", "text_key", "copy"]
    match = F.lit(True)
    left, right = of_rows.alias("l"), placed.join(takes, ["source_key", "start"]).alias("r")
    for c in ids:
        match = match & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    joined = left.join(right, match).select("l.*", "r.taken", "r.size", "r.parts")
    words = F.filter(F.split("text", BLANK), lambda w: w != "")
    cut = F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(F.col("words_"), (p["skip"] + 1).cast("int"), p["words"].cast("int")))), " ")
    text = F.when(F.col("taken") == F.col("size"), F.col("text")).otherwise(cut)
    out = joined.withColumn("words_", words).withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out.select(*docs.columns)
