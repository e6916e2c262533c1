"""Fill-in-the-middle against regular expressions, and the exact way back."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantspark.llm import infill

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)
ALPHABET = list("abZAz@[`{éß日𐍈 \n_0\x7f\x80\xff") + ["<P>", "<S", "<M>", "word", "\u0000"]


def by_hand(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("span", [1, 2, 1 << 16])
def test_unit_ends(monkeypatch, span):
    monkeypatch.setattr(infill, "SPAN", span)
    draw = random.Random(span)
    for _ in range(300):
        texts = ["".join(draw.choices(ALPHABET, k=draw.randint(0, 30))) for _ in range(draw.randint(1, 6))]
        offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
        units = infill.Units(np.frombuffer("".join(texts).encode(), np.uint8), offsets[:-1], offsets[1:])
        for i, text in enumerate(texts):
            ends = [0] + [len(text[: m.end()].encode()) for m in UNIT.finditer(text)]
            assert units.counts()[i] == len(ends) - 1
            assert (units.select(np.full(len(ends), i), np.arange(len(ends))) - offsets[i]).tolist() == ends


def compared(df):
    done = infill.fill_in_middle(df)
    rows = done.withColumn("back", infill.restored()).collect()
    mine = sorted((str(r.doc_id), r.n, r.form, str(r.prefix_chars), str(r.middle_chars), r.output) for r in rows)
    theirs = sorted((str(r.doc_id), *(v if i in (0, 1, 4) else str(v) for i, v in enumerate(by_hand(r.doc_id, r.text)))) for r in df.select("doc_id", "text").collect())
    assert mine == theirs
    assert sorted(r.back for r in rows) == sorted(r.text or "" for r in df.select("text").collect())
    return rows


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = compared(docs)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    out = infill.digests(infill.fill_in_middle(docs)).join(docs, "doc_id").collect()
    assert all(r.restored_sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in out)


def test_odd_rows(spark):
    draw = random.Random(3)
    rows = [(None, "no id"), (1, None), (2, ""), (3, "x"), (3, "x"), (4, "a<M>b"), (5, "<S<P<M " * 9), (6, "日本 語é" * 90_000), (7, "a" * 3_000_000)]
    rows += [(100 + i, "".join(draw.choices(ALPHABET, k=40))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("id", "n", "form", "output", "h1", "prefix_chars"):
        df = df.withColumn(name, F.lit("own"))
    compared(df)


def test_empty_table(spark):
    assert infill.digests(infill.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
