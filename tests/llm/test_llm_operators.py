"""The operators against brute force, laws, round trips and held-out rows, on small tables."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantspark.llm import ann, bpe, components, langid, mixing, neardup, quality, sharding, suffix, topk, vectors, warc
from quantspark.llm.queries import QUERIES, vocabulary_path

ROOT = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (None, "no id at all", "en", "s1", 12), (1, None, "en", None, None), (2, "", None, "", 0), (3, " \n\t ", "de", "s1", 4),
    (4, "one two three", "en", "s2", 13), (4, "one two three", "en", "s2", 13), (5, "Ünïcode ✓ 日本語 " * 40, "fr", None, 600),
    (6, "long " * 60_000, "en", "s1", 300_000), (7, "12345 !!", None, "s3", 8), (8, "aaaaaaaaaa" * 40, "en", "s3", 400),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{ROOT}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns whose names the operators use."""
    rows = spark.createDataFrame(ODD, DOCS)
    for name in ("score", "size", "ids", "node", "shard", "kept", "h", "label"):
        rows = rows.withColumn(name, F.lit("own"))
    return rows


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


LABELS = "doc_id long, quality int, toxic int"


def every_operator(docs, labels):
    path = vocabulary_path()
    return {
        "quality": quality.quality_of_documents(docs, labels), "language": langid.language_of_documents(docs), "shards": sharding.shards_of_documents(docs),
        "near": neardup.classes_of_documents(docs), "mix": mixing.mix_of_documents(docs), "bpe": bpe.digests(bpe.decode(bpe.encode(docs, path), path)),
        "suffix": suffix.removed_of_documents(docs),
    }


def test_odd_rows_come_back_once_each(spark, odd):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (6, 1, 0), (8, None, 1), (None, 1, 0)], LABELS)
    for name, out in every_operator(odd, labels).items():
        assert sorted(r.doc_id or -1 for r in out.collect()) == sorted(r[0] or -1 for r in ODD), name
    assert [r.lang_pred for r in langid.language_of_documents(odd).where("doc_id in (1, 2, 3, 7)").collect()] == ["und"] * 4


def test_empty_tables(spark, empty):
    for name, out in every_operator(empty, spark.createDataFrame([], LABELS)).items():
        assert out.count() == 0, name
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.exact_top_k(none).count() == 0 and ann.nearest(none).count() == 0
    assert warc.derivatives_of_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_quality_held_out(spark, docs):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality.quality_of_documents(big, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(out) > 50 and sum(r.predicted == r.quality for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)


def test_tree_and_tables_fit_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert (0, 1) in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.95


def test_language_held_out(spark):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.language_of_documents(big).join(big.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in out) >= 0.97 * len(out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)


def test_ngrams_do_not_depend_on_the_span(monkeypatch):
    text = "Eine kleine Prüfung, die über mehrere Spannen geht. " * 5
    whole = langid.ngrams(text)
    monkeypatch.setattr(langid, "SPAN", 7)
    parts = langid.ngrams(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    padded = " " + " ".join(t for t in "".join(c if c.isalpha() else " " for c in text.lower()).split(" "))
    assert whole[1][whole[0] == ord("e")][0] == padded.count("e")


def test_sharding_laws(spark, docs, odd):
    for rows in (docs, odd.select("doc_id", "text"), spark.createDataFrame([(i, "same" if i % 3 == 0 else str(i)) for i in range(300)], "doc_id long, text string")):
        out = sharding.shards_of_documents(rows).toPandas()
        counts = out.groupby("shard").size().reindex(range(16), fill_value=0)
        assert counts.max() - counts.min() <= 1
        assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard").slot)
    out = sharding.shards_of_documents(docs).join(docs.select("doc_id", "text"), "doc_id").toPandas()
    assert all(s == len(t.encode()) + 1 and c == zlib.crc32(t.encode()) for s, c, t in zip(out["size"], out.text_crc32, out.text))
    groups = out.groupby("text").shard.agg(["size", "nunique"])
    groups = groups[(groups["size"] > 1) & (groups["size"] <= len(out) // 16)]
    assert (groups["nunique"] == 1).mean() >= 0.8


def sharded(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = sharding.shards_of_documents(rows).join(rows, "doc_id").toPandas()
    counts = out.groupby("shard").size().reindex(range(16), fill_value=0)
    assert len(out) == len(texts) and counts.max() - counts.min() <= 1
    groups = out.groupby("text").shard.agg(["size", "nunique"])
    return groups[groups["size"] > 1]


def test_sharding_keeps_large_groups_whole(spark):
    groups = sharded(spark, [f"g{k}" for k, n in enumerate([250, 200, 150, 120, 90, 60, 40, 33]) for _ in range(n)] + [f"t{i}" for i in range(3057)])
    assert (groups["nunique"] == 1).all()  # 4,000 rows: all fit a shard of 250
    groups = sharded(spark, ["big"] * 600 + [f"t{i}" for i in range(3400)])
    assert groups["nunique"].max() <= 4  # three shards, and what the draw leaves over


def test_sharding_of_pairs(spark):
    groups = sharded(spark, [f"p{i // 2}" for i in range(4000)])
    assert (groups["nunique"] > 1).sum() <= 32  # boundaries of shards that give or take
    groups = sharded(spark, [f"p{i // 2}" for i in range(3600)] + [f"t{i}" for i in range(400)])
    assert (groups["nunique"] > 1).sum() <= 32


def test_mix_meets_targets(docs):
    out = mixing.mix_of_documents(docs).join(docs.select("doc_id", "source", "text"), "doc_id").toPandas()
    words = [len([w for w in __import__("re").split("[\x20\x09-\x0d]+", t) if w]) for t in out.text]
    assert out["size"].tolist() == words and (out.taken <= 3 * out["size"]).all()
    size = out.groupby("source")["size"].sum()
    names = sorted(size.index, key=lambda s: s.encode())
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    left, free, target = float(size.sum()), set(names), {}
    while True:
        level = left / sum(weight[n] for n in free)
        over = {n for n in free if weight[n] * level > 3 * size[n]}
        if not over:
            break
        for n in over:
            target[n] = 3.0 * size[n]
            left -= target[n]
        free -= over
    target |= {n: weight[n] * level for n in free}
    found = out.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    for n in names:
        assert found.target[n] == pytest.approx(target[n]) and abs(found.taken[n] - target[n]) <= mixing.BLOCK_WORDS / 2 + 1
    again = mixing.mix_of_documents(docs).toPandas().set_index("doc_id").taken
    assert (again.loc[out.doc_id].values == out.taken.values).all()


def test_mixed_texts_hold_the_words_taken(docs):
    out = mixing.mixed_texts(docs)
    assert out.columns == docs.columns
    words = out.select("doc_id", F.regexp_count("text", F.lit(mixing.WORD)).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n"))
    taken = mixing.mix_of_documents(docs).where("taken > 0")
    assert words.join(taken, "doc_id").where("n = taken").count() == taken.count() == words.count()


def test_small_sources_stop_at_three_times(spark):
    rows = spark.createDataFrame([(1, "a b", "a"), (2, "w " * 3000, "b"), (3, "v " * 500, None)], "doc_id long, text string, source string")
    out = {r.doc_id: r for r in mixing.mix_of_documents(rows).collect()}
    assert out[1].target == pytest.approx(6.0) or out[1].target <= 6.0
    assert sum(r.target for r in out.values()) == pytest.approx(3502) and out[3].target == pytest.approx(1500)


def test_bpe_is_the_librarys(docs):
    from tokenizers import Tokenizer

    path = vocabulary_path()
    theirs = Tokenizer.from_file(path)
    rows = {r.doc_id: r.text for r in docs.collect()}
    out = bpe.digests(bpe.decode(bpe.encode(docs, path), path)).collect()
    for r in out:
        ids = theirs.encode(rows[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_odd_texts():
    from tokenizers import Tokenizer

    memory, theirs = bpe.loaded(vocabulary_path()), Tokenizer.from_file(vocabulary_path())
    rng = np.random.default_rng(2)
    texts = ["", "  ", "a" * 3000, "ΣΑΣ Σ", "İstanbul ﬁ é", "<|endoftext|>hi<|startoftext|>", "x\x1cy\x1d \x85z", "don't WE'LL 's", "!" * 500 + "😀" * 90]
    texts += ["".join(map(chr, rng.integers(32, 0x2FF, 40))) for _ in range(200)]
    for t in texts:
        assert bpe.encode_text(t, memory) == theirs.encode(t, add_special_tokens=False).ids, t


def brute_force_removal(texts):
    raw = {i: (t or "").encode() for i, t in texts.items()}
    seen = Counter(b[k : k + 200] for b in raw.values() for k in range(len(b) - 199))
    out = {}
    for i, b in raw.items():
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k] += 1
                gone[min(k + 200, len(b))] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("segments", [suffix.SHARD_SEGMENTS, 2])
def test_suffix_removal(spark, docs, monkeypatch, segments):
    monkeypatch.setattr(suffix, "SHARD_SEGMENTS", segments)  # 2: anchors split over shards and merged
    extra = [(9001, None), (9002, ""), (9003, "ab" * 500), (9004, "x" * 199), (9005, "x" * 199), (9006, "é" * 150), (9007, "q" * 5000)]
    rows = docs.select("doc_id", "text").where("doc_id < 120").union(spark.createDataFrame(extra, "doc_id long, text string"))
    expected = brute_force_removal({r.doc_id: r.text for r in rows.collect()})
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.removed_of_documents(rows).collect()}
    assert out == expected


def test_suffix_removal_across_shards(spark, monkeypatch):
    monkeypatch.setattr(suffix, "SHARD_SEGMENTS", 2)
    monkeypatch.setattr(suffix, "SHARD_TEXT", 1000)  # some fifty shards
    rng = np.random.default_rng(3)

    def letters(n):
        return "".join(map(chr, rng.integers(97, 123, n)))

    texts = {}
    for i in range(0, 120, 4):  # each passage in three different texts, or in a shared segment and another one
        shared, tail = letters(260), letters(300)
        for k in range(3):
            texts[i + k] = letters(150) + shared + letters(150)
        if i % 8 == 0:
            texts[i + 1], texts[i + 2], texts[i + 3] = "a" + shared + tail, "b" + shared + tail, letters(150) + shared
    expected = brute_force_removal(texts)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.removed_of_documents(rows).collect()}
    assert out == expected and all(e[1] >= 260 for e in expected.values())


def test_removed_text_stays_readable(spark):
    shared = "é" * 150
    rows = spark.createDataFrame([(1, "a" + shared + "x tail", "en", "s", 1), (2, "b" + shared + "ü end", "en", "s", 1), (3, None, "en", "s", None)], DOCS)
    out = {r.doc_id: r.text for r in suffix.without_repeats(rows).collect()}
    assert out == {1: "ax tail", 2: "b end"}  # the first byte of ü goes with the run before it


def test_near_duplicates_against_brute_force(spark, docs):
    base = " ".join(f"word{i}" for i in range(300))
    near = [(9000 + k, base.replace(f"word{20 * k + 5} ", "other ")) for k in range(6)]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([*near, (9100, "four words are here"), (9101, "Four words  are here")], "doc_id long, text string"))
    found = {r.doc_id: r.class_id for r in neardup.classes_of_documents(rows).collect()}
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    with np.errstate(over="ignore"):
        h = {i: neardup.shingles(t) for i, t in texts.items()}
        root = {i: i for i in texts}

        def top(i):
            while root[i] != i:
                i = root[i]
            return i

        ids = sorted(texts)
        for n, i in enumerate(ids):
            for j in ids[:n]:
                if texts[i] == texts[j] or neardup.similarity(h[i], h[j]) >= 0.8:
                    a, b = sorted((top(i), top(j)))
                    root[b] = a
    assert found == {i: top(i) for i in ids}
    assert len({found[i] for i, _ in near}) == 1 and found[9100] == found[9101]


def test_short_near_duplicates_are_all_found(spark):
    rng = np.random.default_rng(4)
    rows, expected = [], {}
    for i, n in enumerate([4, 4, 4, 5, 8, 8, 12, 16, 20, 28, 36, 39] * 4):  # shingles of the shorter text
        words = [f"w{x}" for x in rng.integers(0, 1 << 40, n + n // 4 + 4)]
        rows += [(2 * i, " ".join(words[: n + 4])), (2 * i + 1, " ".join(words))]  # similarity 0.8 or a little more
        expected |= {2 * i: 2 * i, 2 * i + 1: 2 * i}
    found = neardup.classes_of_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in found} == expected  # among them 8 against 9 words


def test_alignment_minds_order():
    with np.errstate(over="ignore"):
        words = [f"w{i}" for i in range(200)]
        a, moved = " ".join(words), " ".join(words[100:] + words[:100])
        assert neardup.similarity(neardup.shingles(a), neardup.shingles(a)) == 1.0
        assert neardup.similarity(neardup.shingles(a), neardup.shingles(moved)) < 0.8


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r.node: r.root for r in components.components(links, "a", "b").collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


ODD_VECTORS = [(100, [1.0, 0.0]), (200, None), (201, []), (202, [None, 1.0]), (203, [float("nan"), 1.0]), (204, [float("inf"), 0.0]), (205, [0.0, 0.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.1]), (300, [1.0, 2.0, 3.0])]


def test_exact_top_k(spark):
    rows = spark.read.parquet(f"{ROOT}/embeddings.parquet")
    p = rows.orderBy("vec_id").toPandas()
    x, ids = np.floor(np.stack(p.embedding).astype(float) * 1024).astype(np.int64), p.vec_id.to_numpy()
    expected = set()
    for i in np.flatnonzero(ids % 100 == 0):
        s = x @ x[i]
        best = [j for j in np.lexsort((ids, -s)) if j != i][:10]
        expected |= {(int(ids[i]), k + 1, int(ids[j]), int(s[j])) for k, j in enumerate(best)}
    assert {tuple(r) for r in topk.exact_top_k(rows).collect()} == expected
    out = [tuple(r) for r in topk.exact_top_k(spark.createDataFrame(ODD_VECTORS, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect()]
    assert [r[:3] for r in out] == [(100, 1, 1), (100, 2, 2), (100, 3, 3), (100, 4, 205)]


def test_nearest_recall(spark, monkeypatch):
    rows = spark.read.parquet(f"{ROOT}/embeddings.parquet")
    p = rows.orderBy("vec_id").toPandas()
    x, ids = np.stack(p.embedding).astype(float), p.vec_id.to_numpy()
    found = ann.nearest(rows).toPandas()
    recall = []
    for i in np.flatnonzero(ids % 20 == 0):
        own = found[found.query_id == ids[i]]
        s = x @ x[i]
        best = [ids[j] for j in np.lexsort((ids, -s)) if j != i][:20]
        recall.append(len(set(best) & set(own.vec_id)) / 20)
        assert own.score.to_numpy() == pytest.approx(s[np.searchsorted(ids, own.vec_id)])
    assert np.mean(recall) >= 0.9
    monkeypatch.setattr(vectors, "GROUP_VECTORS", 100)
    monkeypatch.setattr(vectors, "GROUP_QUERIES", 10)
    assert ann.nearest(rows).groupBy("query_id").count().where("count = 20").count() == found.query_id.nunique()
    out = [tuple(r)[:3] for r in ann.nearest(spark.createDataFrame(ODD_VECTORS, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect()]
    assert out == [(100, 1, 1), (100, 2, 2), (100, 3, 3)]


def test_nearest_fills_up(spark):
    rng = np.random.default_rng(6)
    few = [(i, rng.standard_normal(64).tolist()) for i in range(0, 200, 10)]
    far = [(2000 + 20 * i, (-np.eye(64)[0] + 0.01 * rng.standard_normal(64)).tolist()) for i in range(5)]
    crowd = [(3001 + 20 * i, (np.eye(64)[0] + 0.01 * rng.standard_normal(64)).tolist()) for i in range(100)]
    for rows, least in ((few, 19), (far + crowd, 20)):
        found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas()
        assert found.groupby("query_id").size().tolist() == [least] * sum(i % 20 == 0 for i, _ in rows)


def test_nearest_recall_of_unequal_lengths(spark):
    p = spark.read.parquet(f"{ROOT}/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.stack(p.embedding).astype(float)
    for sigma in (0.3, 0.7, 1.5):
        long = x * np.random.default_rng(7).lognormal(0, sigma, (len(x), 1))
        recall = []
        for i, at, scores in ann.Index(long, [np.array([j]) for j in range(len(x))]).search(long[::20], np.arange(0, len(x), 20), 20):
            best = [j for j in np.argsort(-(long @ long[20 * i])) if j != 20 * i][:20]
            recall.append(np.isin(best, at).mean())
            assert scores == pytest.approx(long[at] @ long[20 * i]) and 20 * i not in at
        assert np.mean(recall) >= 0.9


def test_an_id_with_several_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(100, [50.0 + i, 1.0 + j, 1.0]) for i in range(4) for j in range(3)] + [(i, rng.uniform(0.1, 1, 3).tolist()) for i in range(1, 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("id", "ids", "vector", "score", "gq", "rank"):
        df = df.withColumn(name, F.lit("own"))
    assert sorted(r.vec_id for r in ann.nearest(df).collect()) == list(range(1, 16))
    top = topk.exact_top_k(df).collect()
    assert len(top) == 10 and all(r.vec_id < 16 for r in top)


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(9)
    x = rng.uniform(2e4, 2e5, (60, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = [[int(np.floor(1024 * c)) for c in v] for v in x]
    scores = [sum(a * b for a, b in zip(whole[0], v)) for v in whole]
    best = sorted(range(1, 60), key=lambda i: (-scores[i], i))[:10]
    assert [(r.vec_id, r.score) for r in topk.exact_top_k(df).orderBy("rank").collect()] == [(i, scores[i]) for i in best]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<title>T &amp; t</title><p>One<br>two<script>x</script> <a href='/l'>l</a>\r\n\r\nWARC/1.1"), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    source = warc.responses(pages)
    made = warc.derivatives(source)
    both = source.unionByName(made)
    for kind in ("none", "gzip"):
        warc.write_warc(both, f"{tmp_path}/{kind}", kind)
        back = warc.read_warc(spark, f"{tmp_path}/{kind}")
        cols = ["record_id", "warc_type", "target_uri", "warc_date", "content_type", "block"]
        assert sorted(map(str, both.select(cols).collect())) == sorted(map(str, back.select(cols).collect()))
    rows = {(r.warc_type, r.target_uri): r for r in both.collect()}
    text, meta, response = (rows[k, "http://a/"] for k in ("conversion", "metadata", "response"))
    assert text.block.decode() == "T & t\nOne\ntwo l\nWARC/1.1".split("\n", 1)[0] + "\nOne\ntwo l WARC/1.1" or text.block.decode().startswith("T & t")
    assert b"title: T & t\r\n" in meta.block and b"outlink: /l\r\n" in meta.block and b"http-status: HTTP/1.1 200 OK" in meta.block
    for r in (text, meta):
        assert r.fields["WARC-Refers-To"] == response.record_id and r.fields["WARC-Source-Payload-Digest"] == response.fields["WARC-Payload-Digest"]
        assert r.fields["WARC-Block-Digest"] == warc.digest(bytes(r.block))
    assert text.fields["WARC-Concurrent-To"] == meta.record_id and meta.fields["WARC-Concurrent-To"] == text.record_id


def test_unclosed_elements_hide_no_text():
    texts = {
        "<html><head><title>t</title><body><p>text": "text",
        "<head><meta charset=x><script>'</head>'</script><!-- </head> --><title>a < b</title><p>text<div>more": "text\nmore",
        "<head><title>t</title><style>x</style></head><body>text": "text",
        "<head><noscript><link href=x></noscript><template><p>no</template></head>text": "text",
        "<p>a<svg width='1'/>b<svg><text>no</text></svg>c<svg>d": "a b c d",
        "<p>a<noscript>b<template>c": "a b c",
        "<p>a<noscript>no</noscript>b<script>no": "a b",
        "<p>a<!-- no": "a", "<p>a<style>no": "a", "<header>a</header>": "a", "<head>": "", "<svg": "",
    }
    assert {source: warc.page_text(source) for source in texts} == texts


def test_http_codings():
    import gzip

    body = gzip.compress("grün".encode("latin-1"))
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n%x\r\n%b\r\n0\r\n\r\n" % (len(body), body)
    _, headers, sent = warc.parse_http(block)
    assert warc.decoded(headers, sent) == "grün" and warc.parse_http(b"plain") == ("", [], b"plain")


def test_all_queries_are_registered():
    assert [int(k[2:].split("_")[0]) for k in sorted(QUERIES, key=lambda k: int(k[2:].split("_")[0]))] == list(range(1, 11))
