"""The mix against a plain rebuilding of every step, and the laws of its draws and permutations."""

import hashlib
import re
import struct
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from quantspark.llm import mixing

ROWS = "doc_id long, text string, source string"
B = mixing.BLOCK_WORDS


def h64(*values) -> int:
    """Chained 64-bit hashes, signed: booleans and small numbers as (value, 4), numbers as 8 bytes, texts as UTF-8."""
    seed = 42
    for v in values:
        if v is None:
            continue
        data = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def shuffled(at: int, n: int, key: int) -> int:
    for i in range(1, mixing.ROUNDS + 1):
        distance = h64(key, (i, 4)) % (1 << 64) >> 1
        other = (distance - at) % n
        at = other if h64(distance, max(at, other)) % 2 == 0 else at
    return at


def plain_mix(rows, shards):
    """(shard, source, epoch, doc_id, words taken) of every piece, and the target of every source."""
    words = lambda t: len(re.findall(mixing.WORD, t or ""))
    text_key = lambda t: None if t is None else hashlib.md5(t.encode()).hexdigest()
    keys = sorted({(s is None, s or "") for _, _, s in rows}, key=lambda k: (k[0], k[1].encode()))
    size = {k: sum(words(t) for _, t, s in rows if (s is None, s or "") == k) for k in keys}
    weight = {k: i % 3 + 1 for i, k in enumerate(keys)}
    target, free, left = {}, list(keys), float(sum(size.values()))
    while free:
        level = left / sum(weight[k] for k in free)
        over = [k for k in free if weight[k] * level > 3 * size[k]]
        for k in over or free:
            target[k] = 3.0 * size[k] if over else weight[k] * level
        left -= sum(target[k] for k in over)
        free = [k for k in free if k not in target]
    plan = {}
    for k in keys:
        full, tail = divmod(size[k], B)
        blocks, passes = full + (tail > 0), int(target[k] // max(size[k], 1))
        more = target[k] - passes * size[k]
        rest = min(int(more / B + 0.5), full)
        plan[k] = full, blocks, passes, rest, passes * blocks + rest + (tail > 0 and more - rest * B >= tail / 2)
    total = sum(p[4] for p in plan.values())
    owner = [k for k in keys for _ in range(plan[k][4])]
    of_shard = -(-total // shards)
    counts = Counter((owner[h64("draw", i) % total], i // of_shard) for i in range(total))
    free_slots = []
    for k in keys:
        due, n, upto = plan[k][4], sum(v for (s, _), v in counts.items() if s == k), 0
        for shard in range(shards):
            had, upto = upto, upto + counts[k, shard]
            back = upto * max(n - due, 0) // max(n, 1) - had * max(n - due, 0) // max(n, 1)
            counts[k, shard] -= back
            free_slots += [shard] * back
    free_slots.sort()
    for k in keys:
        for _ in range(plan[k][4] - sum(counts[k, s] for s in range(shards))):
            counts[k, free_slots.pop(0)] += 1
    buckets = max(mixing.LEAST_BUCKETS, len(rows) // mixing.BUCKET_ROWS)
    laid = defaultdict(list)
    for i, t, s in sorted(rows, key=lambda r: (h64(r[0], text_key(r[1])) % buckets, r[0], words(r[1]), text_key(r[1]) or "")):
        laid[s is None, s or ""] += [i] * words(t)
    pieces = Counter()
    for k in keys:
        full, blocks, passes, rest, _ = plan[k]
        numbers = [shard for shard in range(shards) for _ in range(counts[k, shard])]
        for slot, shard in enumerate(numbers):
            epoch, index = divmod(slot, blocks)
            whole = index < (full if epoch < passes else rest)
            block = shuffled(index, full, h64((k[0], 4), k[1], epoch)) if whole else full
            for doc in laid[k][block * B : block * B + B]:
                pieces[shard, k[1], epoch, doc] += 1
    return pieces, {k[1]: target[k] for k in keys}


@pytest.fixture(scope="module")
def rows():
    out = [(i, f"w{i} " * (37 * i % 400), "abcd"[i % 4] if i % 3 else "a") for i in range(1, 181)]
    return out + [(500, "big " * 9000, "hot"), (501, "x " * 5, None), (502, None, "a"), (503, "", "void"), (7, "w7 " * 3, "b"), (7, "w7 " * 3, "b")]


def test_mix_is_the_plain_one(spark, rows):
    docs = spark.createDataFrame(rows, ROWS)
    for shards in (5, 64):
        documents, found = mixing.mix(docs, shards=shards)
        held = documents.select("doc_id", "source_key", "start").where("size > 0")
        got = found.join(held, ["source_key", "start"]).groupBy("shard", F.col("source_key.name").alias("name"), "epoch", "doc_id").agg(F.sum("words").alias("n"))
        pieces, target = plain_mix(rows, shards)
        assert {(r["shard"], r["name"], r.epoch, r.doc_id): r.n for r in got.collect()} == dict(pieces)
        for r in documents.select("source_key.name", "target").distinct().collect():
            assert r.target == pytest.approx(target[r["name"]])


def test_shards_draw_their_sources(spark):
    """Shards are equally long, sources meet their slots, counts by shard vary as draws do."""
    n, shares = 64_000, {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}
    rows = [(i, *k) for i, k in enumerate([("x " * 640, s) for s, p in shares.items() for _ in range(int(n * p / 10))])]
    sources = mixing.wanted(mixing.targets(mixing.sized(spark.createDataFrame(rows, ROWS), "source", "text")))
    due = {r.source_key.name: r.slots for r in sources.collect()}
    slots = mixing.slots_of(sources, 40).groupBy("shard", F.col("source_key.name").alias("name")).count().collect()
    assert Counter({k: sum(r["count"] for r in slots if r["name"] == k) for k in due}) == Counter(due)
    length = Counter()
    for r in slots:
        length[r["shard"]] += r["count"]
    total = sum(due.values())
    assert set(length.values()) == {-(-total // 40), total - 39 * -(-total // 40)} or set(length.values()) == {total // 40}
    chi = sum((r["count"] - due[r["name"]] / 40) ** 2 / (due[r["name"]] / 40) for r in slots)
    free = 39 * (len([k for k in due if due[k]]) - 1)
    assert 0.5 * free < chi < 1.6 * free  # neither rounded targets nor lumps


def test_permutations(spark):
    """Every length is permuted, those too at which a fixed multiplier would leave runs."""
    for n in (1, 2, 3, 7, 64, 100, 1_100, 4_100):
        out = spark.range(n).select("id", *[mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(k).cast("long")).alias(f"k{k}") for k in (1, 2)]).orderBy("id").toPandas()
        for k in ("k1", "k2"):
            assert sorted(out[k]) == list(range(n))
            if n >= 100:
                steps = Counter((out[k].diff().dropna().astype(int) % n).tolist())
                assert steps.most_common(1)[0][1] < 12 and (out[k] == out.id).sum() < 10
        assert n < 100 or (out.k1 == out.k2).sum() < 12


def test_sums_of_all_rows_before(spark):
    df = spark.range(5_000).select((F.col("id") * 7919 % 5_000).alias("place"), F.col("id").alias("n"))
    got = mixing.running(df, ["place"], {"before": F.col("n")}).orderBy("place").collect()
    total = 0
    for r in got:
        assert r.before == total
        total += r.n
    assert len(got) == 5_000 and mixing.running(df.where("n < 0"), ["place"], {"before": F.col("n")}).count() == 0


def test_odd_rows_and_clashing_names(spark):
    rows = [(None, "no id at all", "s1"), (1, None, None), (2, "", ""), (4, "one two three", "s2"), (4, "one two three", "s2"), (6, "long " * 20_000, "s1"), (7, "x", None)]
    docs = spark.createDataFrame(rows, ROWS)
    for name in ("shard", "block", "blocks", "slots", "size", "start", "n", "lay_", "drawn", "target", "epoch", "key", "source_key"):
        docs = docs.withColumn(name, F.lit("own"))
    out = mixing.mix_of_documents(docs).collect()
    assert sorted(r.doc_id or -1 for r in out) == [-1, 1, 2, 4, 4, 6, 7]
    assert all(r.taken <= 3 * r["size"] and (r.n_shards > 0) == (r.taken > 0) for r in out)
    texts = mixing.mixed_texts(docs)
    assert texts.columns == docs.columns and {r[3] for r in texts.collect()} == {"own"}
    words = texts.select(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0]
    assert words == sum(r.taken for r in out)


def test_empty_and_wordless(spark):
    none = spark.createDataFrame([], ROWS)
    assert mixing.mix_of_documents(none).count() == 0
    out = mixing.mix_of_documents(spark.createDataFrame([(1, None, "a"), (2, " ", None)], ROWS)).collect()
    assert [(r["size"], r.target, r.taken, r.n_shards) for r in out] == [(0, 0.0, 0, 0)] * 2
