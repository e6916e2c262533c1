"""Records whose length cannot be read end where the next one begins."""

import gzip

import pytest

from quantspark.llm.warc import parse_warc


def record(length, block):
    head = b"WARC/1.1\r\nWARC-Type: response\r\n"
    return head + (b"" if length is None else b"Content-Length: " + length + b"\r\n") + b"\r\n" + block + b"\r\n\r\n"


@pytest.mark.parametrize("length", [b"x", None, b"", b"-3", b"9" * 5_000, "٣".encode()])
def test_bad_lengths(length):
    data = record(b"3", b"abc") + record(length, b"a WARC/1.1 inside") + record(b"2", b"yz")
    for whole in (data, gzip.compress(data)):
        assert [r["block"] for r in parse_warc(whole)] == [b"abc", b"a WARC/1.1 inside", b"yz"]
    last = list(parse_warc(record(b"3", b"abc") + record(length, b"to the end")))
    assert [r["block"] for r in last] == [b"abc", b"to the end\r\n\r\n"]


def test_true_lengths_hold_marks_of_records():
    inner = b"one\r\n\r\nWARC/1.1\r\n\r\n"
    assert [r["block"] for r in parse_warc(record(str(len(inner)).encode(), inner) + record(b"0", b""))] == [inner, b""]
