"""Removal of repeated passages by suffix arrays.

Every byte goes that a LENGTH-byte string covers which also starts anywhere else. Each such
window belongs to the least hash among the short strings in it, its anchor; equal windows have
equal anchors. Windows whose anchor occurs once cannot repeat. The rest are cut out as segments,
equal segments fall together, and segments are dealt to shards by anchor. A shard sorts the
suffixes of its segments by Larsson-Sadakane refinement and takes the common prefixes of
neighbours as Kasai does, all segments side by side. An anchor with very many segments is split
over shards; windows unique in their shard are then merged across shards by binary search.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspark.llm.common import own_columns, released, staged
from quantspark.llm.hashing import mixed, stretch_hashes

#: bytes of a repeated string, and of an anchor
LENGTH = 200
ANCHOR = 40
#: window starts read at once of a long text
SPAN = 1 << 19
#: segments of one anchor in one shard; segment bytes of one suffix array; text bytes per shard
SHARD_SEGMENTS = 16_384
ARRAY_BYTES = 2 << 20
SHARD_TEXT = 8 << 20
#: anchors with more runs than text bytes over this are joined by broadcast: fewer than this many
HOT_ANCHORS = 100_000
#: symbols of nine bits that the first sort looks at
FIRST = 7
_ODD = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64((1 << 20) - 1)
_MERGED = np.dtype([("a", ">u8"), ("b", ">u8"), ("k1", "<i8"), ("k2", "<i8"), ("at", "u1")])


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window start, number of windows) of the runs of windows with one anchor."""
    found = []
    width = LENGTH - ANCHOR + 1
    for start in range(0, len(raw) - LENGTH + 1, SPAN):
        part = raw[start : start + SPAN + LENGTH - 1]
        h = stretch_hashes(part, slice(0, len(part) - ANCHOR + 1), slice(ANCHOR, None))
        # the least value of each window, its place in the low bits: ties go to the first
        v = ((h * _ODD) & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while 2 * size <= width:
            v = np.minimum(v[:-size], v[size:])
            size *= 2
        if size < width:
            v = np.minimum(v[: len(v) - (width - size)], v[width - size :])
        at = (v & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        found.append((mixed(h[at[first]]), first + start, np.diff(np.append(first, len(at)))))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(map(np.concatenate, zip(*found)))


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Suffixes of the texts in ``x`` in order; each text ends with a 0, and earlier 0s are smaller.

    The first sort looks at FIRST symbols. Each refinement sorts the suffixes of groups that are
    not settled by the rank of the suffix ``depth`` places on, which doubles the depth. Places fit
    32 bits, and what a step leaves goes before the next one: workers keep the memory of their peak.
    """
    n = len(x)
    key, alive = np.zeros(n, np.uint64), np.ones(n, bool)
    for j in range(FIRST):
        alive[n - j :] = False
        alive[: n - j] &= x[j:] != 0
        key <<= np.uint64(9)
        key[: n - j] |= x[j:] * alive[: n - j]
    order = np.argsort(key, kind="stable").astype(np.int32)
    first = np.ones(n, bool)
    key = key[order]
    first[1:] = key[1:] != key[:-1]
    del key
    first |= ~alive[order]  # a suffix that ends within is settled by place
    del alive
    rank = np.arange(n, dtype=np.int32)
    rank *= first
    np.maximum.accumulate(rank, out=rank)
    of = np.empty(n, np.int32)
    of[order] = rank
    depth = FIRST
    while len(open_ := np.flatnonzero(~(first & np.append(first[1:], True))).astype(np.int32)):
        who = order[open_]
        key = rank[open_].astype(np.int64)
        key *= n
        key += of[who + np.int32(depth)]  # what is not settled has not ended at this depth
        sort = np.argsort(key).astype(np.int32)
        who = who[sort]
        order[open_] = who
        key = key[sort]
        del sort
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        del key
        first[open_] = new
        ranks = np.maximum.accumulate(open_ * new)
        rank[open_] = ranks
        of[who] = ranks
        depth *= 2
    return order


def common_prefixes(x: np.ndarray, order: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each suffix the common prefix with the one before it in ``order``, up to LENGTH.

    Kasai's rule, a prefix is one shorter at most for the next suffix of a text, runs through
    all texts begin:end side by side.
    """
    before = np.full(len(x), -1, np.int32)
    before[order[1:]] = order[:-1]
    out = np.zeros(len(x), np.int16)
    p, stop = begin.copy(), end.copy()
    q, l = before[p], np.zeros(len(p), np.int64)
    while len(p):
        a = x[p + l]  # a text ends with a separator, so p + l stays inside
        same = (l < LENGTH) & (q >= 0) & (a != 0)
        same[same] = a[same] == x[q[same] + l[same]]
        l[same] += 1
        over = np.flatnonzero(~same)
        out[p[over]] = l[over]
        p[over] += 1
        l[over] = np.maximum(l[over] - 1, 0)
        q[over] = before[np.minimum(p[over], len(x) - 1)]
        if len(over) and (ended := p >= stop).any():
            stay = ~ended
            p, q, l, stop = p[stay], q[stay], l[stay], stop[stay]
    return out


def repeated(segments: list[bytes], windows: np.ndarray) -> list[np.ndarray]:
    """For each segment which of its first ``windows`` starts begin a string that another window equals."""
    size = np.array(list(map(len, segments)))
    end = np.cumsum(size + 1) - 1
    begin = end - size
    x = np.frombuffer(b"\0".join([*segments, b""]), np.uint8).astype(np.uint16)
    x += 1
    x[end] = 0
    order = suffix_array(x)
    prefix = common_prefixes(x, order, begin, end)[order]
    # between two windows that follow one another, the least prefix of all suffixes between counts
    own = np.zeros(len(x) + 1, np.int8)  # segments lie one after another: none or one holds a place
    np.add.at(own, begin, 1)
    np.add.at(own, begin + windows, -1)
    at = np.flatnonzero(np.cumsum(own, dtype=np.int8)[:-1][order] > 0)
    hit = np.zeros(len(x), bool)
    if len(at) > 1:
        equal = np.minimum.reduceat(prefix[: at[-1] + 1], at[:-1] + 1) >= LENGTH
        hit[order[at[1:][equal]]] = True
        hit[order[at[:-1][equal]]] = True
    return [hit[b : b + w] for b, w in zip(begin, windows)]


def identity(text: Column) -> list[Column]:
    """Two hashes that tell distinct texts apart; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("t1"), F.xxhash64(F.lit("second"), t).alias("t2")]


def distinct_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """``t1, t2, raw``: each text of LENGTH bytes or more once; copies fall together before the shuffle."""
    rows = docs.where(F.octet_length(text_col) >= LENGTH).select(*identity(F.col(text_col)), F.col(text_col).cast("binary").alias("raw"))
    return rows.groupBy("t1", "t2").agg(F.first("raw").alias("raw"))


def with_anchors(texts: DataFrame) -> DataFrame:
    """``h, t1, t2, place`` of every run of windows; place is 256 times the first start plus windows less one."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for start in range(0, batch.num_rows, 128):
                    part = batch.slice(start, 128)
                    found = [anchors(np.frombuffer(raw.as_buffer(), np.uint8)) for raw in part.column(2)]
                    times = [len(f[0]) for f in found]
                    t1, t2 = (np.repeat(part.column(i).to_numpy(), times) for i in (0, 1))
                    place = np.concatenate([f[1] * 256 + f[2] - 1 for f in found])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([f[0] for f in found]).view(np.int64)), pa.array(t1), pa.array(t2), pa.array(place)], names=["h", "t1", "t2", "place"]
                    )

    return texts.mapInArrow(run, "h long, t1 long, t2 long, place long")


def with_segments(rows: DataFrame) -> DataFrame:
    """Cuts the segments of ``places`` (h, n, place) out of ``raw``; k1, k2 identify a segment."""
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("place", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("segment", pa.binary())])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                t1, t2, raw, places = (batch.column(c)[i] for c in range(4))
                raw, places = raw.as_py(), places.values
                h, n, place = (places.field(c).to_numpy() for c in range(3))
                for begin in range(0, len(place), 4096):
                    at = place[begin : begin + 4096]
                    cut = [raw[p >> 8 : (p >> 8) + (p & 255) + LENGTH] for p in at.tolist()]
                    keys = np.frombuffer(b"".join(hashlib.blake2b(c, digest_size=16).digest() for c in cut), "<i8").reshape(-1, 2)
                    k = len(at)
                    cols = [h[begin : begin + k], n[begin : begin + k], np.full(k, t1.as_py()), np.full(k, t2.as_py()), at, keys[:, 0].copy(), keys[:, 1].copy()]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(cut, pa.binary())], schema=schema)

    return rows.select("t1", "t2", "raw", "places").mapInArrow(run, "h long, n long, t1 long, t2 long, place long, k1 long, k2 long, segment binary")


def shard_matches(rows: DataFrame, ranges: int) -> DataFrame:
    """Per shard: ``k1, k2, flags``, the repeated windows of a segment as bits, or ``part, blob``, windows left to merge.

    Of a split anchor, one of every distinct window goes on, also of those that repeat in the
    shard: they may equal a window that stands alone in another shard.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        left: dict[int, list[bytes]] = defaultdict(list)
        pdf = pdf.sort_values(["h", "k1", "k2"], ignore_index=True)
        held: list[int] = []
        held_bytes = 0

        def work() -> None:
            part = pdf.iloc[held]
            passed: set[bytes] = set()
            for row, flags in zip(part.itertuples(index=False), repeated(list(part["segment"]), part["windows"].to_numpy())):
                if row.times > 1:  # the whole segment is elsewhere too
                    flags = np.ones(row.windows, bool)
                if flags.any():
                    out.append((row.k1, row.k2, np.packbits(flags).tobytes(), None, None))
                if row.n > SHARD_SEGMENTS:
                    for at, again in enumerate(flags.tolist()):
                        f = hashlib.blake2b(row.segment[at : at + LENGTH], digest_size=16).digest()
                        if again:
                            if f in passed:
                                continue
                            passed.add(f)
                        entry = f + np.array([row.k1, row.k2], "<i8").tobytes() + bytes([at])
                        left[int.from_bytes(f[:4], "big") % ranges].append(entry)
            held.clear()

        for _, group in pdf.groupby("h", sort=False):
            if len(group) == 1 and group["n"].iloc[0] <= SHARD_SEGMENTS:
                row = group.iloc[0]
                if row["times"] > 1:
                    out.append((row["k1"], row["k2"], np.packbits(np.ones(row["windows"], bool)).tobytes(), None, None))
                continue
            size = int(group["segment"].map(len).sum())
            if held and held_bytes + size > ARRAY_BYTES:  # an array is no larger, but for a single anchor
                work()
                held_bytes = 0
            held += group.index.tolist()
            held_bytes += size
        if held:
            work()
        out += [(None, None, None, part, b"".join(sorted(entries))) for part, entries in left.items()]
        frame = pd.DataFrame(out, columns=["k1", "k2", "flags", "part", "blob"], dtype=object)
        return frame.astype({"k1": "Int64", "k2": "Int64", "part": "Int64"})

    return rows.groupBy("shard").applyInPandas(run, "k1 long, k2 long, flags binary, part long, blob binary")


def across_shards(rows: DataFrame) -> DataFrame:
    """Merges what shards left over: a window found in the sorted windows of another shard repeats."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        every = [np.frombuffer(b, _MERGED) for b in pdf["blob"]]
        bits: dict[tuple[int, int], list[int]] = defaultdict(list)
        whole = np.concatenate(every)
        whole = whole[np.lexsort((whole["b"], whole["a"]))]
        first = whole["a"].astype(np.uint64)
        for own in every:  # sorted by window
            a = own["a"].astype(np.uint64)
            lo, hi = np.searchsorted(first, a, "left"), np.searchsorted(first, a, "right")
            for i in np.flatnonzero(hi - lo > 1).tolist():
                if (whole["b"][lo[i] : hi[i]] == own["b"][i]).sum() > 1:
                    bits[int(own["k1"][i]), int(own["k2"][i])].append(int(own["at"][i]))
        out = []
        for (k1, k2), at in bits.items():
            flags = np.zeros(LENGTH, bool)
            flags[at] = True
            out.append((k1, k2, np.packbits(flags).tobytes()))
        return pd.DataFrame(out, columns=["k1", "k2", "flags"]).astype({"k1": "int64", "k2": "int64"})

    return rows.groupBy("part").applyInPandas(run, "k1 long, k2 long, flags binary")


def spans_of(rows: DataFrame) -> DataFrame:
    """``t1, t2, starts, ends``: maximal removed stretches out of a text's (place, flags) list."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = [], []
            for found in batch.column(2).to_pylist():
                at = [(f["place"] >> 8) + np.flatnonzero(np.unpackbits(np.frombuffer(f["flags"], np.uint8))) for f in found]
                at = np.unique(np.concatenate(at))
                cut = np.flatnonzero(np.diff(at) > LENGTH) + 1  # stretches that touch are one
                starts.append(at[np.concatenate([[0], cut])].tolist())
                ends.append((at[np.append(cut - 1, len(at) - 1)] + LENGTH).tolist())
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(starts, kind), pa.array(ends, kind)], names=["t1", "t2", "starts", "ends"])

    lists_ = rows.groupBy("t1", "t2").agg(F.collect_list(F.struct("place", "flags")).alias("found"))
    return lists_.mapInArrow(run, "t1 long, t2 long, starts array<long>, ends array<long>")


def kept_of(texts: DataFrame, spans: DataFrame, as_text: bool) -> DataFrame:
    """``t1, t2, kept, starts, ends`` of the texts that lose something; as text, letters cut in part go."""
    kind = pa.string() if as_text else pa.binary()

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                kept = []
                for raw, starts, ends in zip(part.column(2), part.column(3).to_pylist(), part.column(4).to_pylist()):
                    raw = raw.as_py()
                    rest = [raw[a:b] for a, b in zip([0, *ends], [*starts, len(raw)])]
                    kept.append("".join(x.decode("utf-8", "ignore") for x in rest) if as_text else b"".join(rest))
                cols = [part.column(0), part.column(1), pa.array(kept, kind), part.column(3), part.column(4)]
                yield pa.RecordBatch.from_arrays(cols, names=["t1", "t2", "kept", "starts", "ends"])

    rows = texts.join(spans, ["t1", "t2"]).select("t1", "t2", "raw", "starts", "ends")
    return rows.mapInArrow(run, f"t1 long, t2 long, kept {kind}, starts array<long>, ends array<long>")


def repeated_spans(docs: DataFrame, total: int, text_col: str = "text") -> DataFrame:
    """``t1, t2, starts, ends``: what goes of each distinct text, other than whole copies."""
    texts = distinct_texts(docs, text_col)
    runs = with_anchors(texts)
    often = runs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    # no more than HOT_ANCHORS anchors can have so many of the windows' runs, so these are broadcast
    hot = F.col("n") > total // HOT_ANCHORS
    frequent = F.broadcast(often.where(hot))
    usual = runs.join(frequent.select("h"), "h", "left_anti").join(often.where(~hot), "h")
    places = usual.unionByName(runs.join(frequent, "h")).groupBy("t1", "t2").agg(F.collect_list(F.struct("h", "n", "place")).alias("places"))
    cut = staged(with_segments(texts.join(places, ["t1", "t2"])))
    shards = max(1, total // SHARD_TEXT)
    once = cut.groupBy("h", "k1", "k2").agg(
        F.first("n").alias("n"), (F.first(F.col("place") % 256) + 1).alias("windows"), F.count(F.lit(1)).alias("times"), F.first("segment").alias("segment")
    )
    split = F.pmod(F.col("k1"), F.ceil(F.col("n") / SHARD_SEGMENTS))
    matched = staged(shard_matches(once.withColumn("shard", F.pmod(F.xxhash64("h", split), F.lit(shards))), shards))
    flags = matched.where("flags is not null").select("k1", "k2", "flags").union(across_shards(matched.where("part is not null").select("part", "blob")))
    return spans_of(cut.select("k1", "k2", "t1", "t2", "place").join(flags, ["k1", "k2"]))


def removals(docs: DataFrame, rows: DataFrame, text_col: str, as_text: bool = False) -> DataFrame:
    """``t1, t2, kept, starts, ends`` of every distinct text; ``rows``: t1, t2, n_bytes of every row."""
    kind = "string" if as_text else "binary"
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    spans = staged(repeated_spans(docs, total, text_col))
    copies = rows.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("copies"), F.max("n_bytes").alias("n_bytes"))
    texts = distinct_texts(docs, text_col)
    none = F.array().cast("array<long>")
    plain = texts.join(spans.select("t1", "t2"), ["t1", "t2"], "left_anti").select("t1", "t2", F.col("raw").cast(kind).alias("kept"), none.alias("starts"), none.alias("ends"))
    brief = docs.where(F.coalesce(F.octet_length(text_col), F.lit(0)) < LENGTH).select(*identity(F.col(text_col)), F.coalesce(F.col(text_col), F.lit("")).cast(kind).alias("kept"))
    brief = brief.groupBy("t1", "t2").agg(F.first("kept").alias("kept")).select("t1", "t2", "kept", none.alias("starts"), none.alias("ends"))
    each = kept_of(texts, spans, as_text).union(plain).union(brief)
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    return each.join(copies, ["t1", "t2"]).select(
        "t1", "t2",
        F.when(gone, F.lit("").cast(kind)).otherwise(F.col("kept")).alias("kept"),
        F.when(gone, F.array(F.lit(0).cast("long"))).otherwise(F.col("starts")).alias("starts"),
        F.when(gone, F.array("n_bytes")).otherwise(F.col("ends")).alias("ends"),
    )


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``starts`` and ``ends`` of removed stretches, ``kept`` bytes.

    Whole texts count as UTF-8 bytes, null as empty. A byte goes when a string of LENGTH bytes
    that covers it also starts anywhere else, in another row or in the same text, overlaps
    included; strings are judged on the input. So texts of LENGTH bytes or more with a copy go
    wholly, and shorter texts stay. Repeated rows are copies of each other. An empty table gives
    an empty result; other columns are not read.
    """
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")
    rows = staged(docs.select(id_col, *identity(F.col(text_col)), size))
    return rows.join(removals(docs, rows, text_col), ["t1", "t2"]).select(id_col, "n_bytes", "starts", "ends", "kept")


def removed_of_documents(docs: DataFrame) -> DataFrame:
    """The digest of a removal: texts give their figures and checksum before these join the rows."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    rows = staged(docs.select("doc_id", *identity(F.col("text")), size))
    gone = F.aggregate(F.zip_with("ends", "starts", lambda b, a: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    each = removals(docs, rows, "text").select(
        "t1", "t2", gone.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
    return rows.join(each, ["t1", "t2"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@own_columns
def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut from the texts; what keeps no word goes; the same columns, whatever their names.

    A letter whose bytes are cut in part goes wholly. Null and empty texts keep no word; an empty
    table gives an empty result.
    """
    rest = docs.select(*identity(F.col("text")), *[c for c in docs.columns if c != "text"])
    rows = staged(docs.select(*identity(F.col("text")), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")))
    each = removals(docs, rows, "text", as_text=True).select(F.col("t1").alias("k1"), F.col("t2").alias("k2"), F.col("kept").alias("text"))
    out = rest.join(each, (F.col("t1") == F.col("k1")) & (F.col("t2") == F.col("k2"))).where(F.trim("text") != "")
    return (out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out).select(*docs.columns)

