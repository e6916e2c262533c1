"""Fill-in-the-middle by arithmetic inside 64-bit words.

A unit is a run of ASCII letters or any other single code point. The UTF-8 bytes of a batch are
read as little-endian 64-bit words. Without looking at single bytes, arithmetic sets the top bit
of every byte that ends a unit; the set bits of each word are counted, and their running total
says how many units end before it. The place of a text's k-th end is found by searching the
running total for its word, then by selecting the bit inside the word with byte-wise prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspark.llm.common import pieces

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: of 100 texts so many change at all, and of 100 changed ones so many put the suffix first
CHANGED, SUFFIX_FIRST = 90, 20
#: hashed in front of an id, so that another run can draw other cuts
SEED = "1"
#: words marked at a time; only their counts stay
SPAN = 1 << 16

ONES = np.uint64(0x0101010101010101)
TOPS = np.uint64(0x8080808080808080)
LOWS = np.uint64(0x7F7F7F7F7F7F7F7F)


def every(byte: int) -> np.uint64:
    """A word with ``byte`` in all eight places."""
    return np.uint64(byte) * ONES


def letters(words: np.ndarray) -> np.ndarray:
    """The top bit of every byte that is an ASCII letter: sums of seven-bit parts cannot carry over."""
    lower = (words & LOWS) | every(0x20)
    from_a = lower + every(0x80 - ord("a"))
    after_z = lower + every(0x80 - ord("z") - 1)
    return from_a & ~after_z & ~words & TOPS


def inner_bytes(words: np.ndarray) -> np.ndarray:
    """The top bit of every byte that goes on with a code point (10xxxxxx)."""
    return words & ~(words << np.uint64(1)) & TOPS


class Units:
    """The unit ends of texts that lie end to end in one buffer."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """``raw`` holds the bytes; text i is raw[starts[i]:ends[i]], in order and without gaps."""
        size = -(-(len(raw) + 1) // 8) + 1  # a zero byte, and a word of zeros, follow the last text
        padded = np.zeros(8 * size, np.uint8)
        padded[: len(raw)] = raw
        self.words = padded.view("<u8")
        self.starts, self.ends = starts, ends
        last = ends[ends > starts] - 1  # a text's last byte ends a unit, whatever the next text begins with
        self.last_word, self.last_bit = last >> 3, np.uint64(0x80) << (np.uint64(8) * (last & 7).astype(np.uint64))
        counts = np.zeros(size, np.int64)
        for begin in range(0, size - 1, SPAN):
            at = np.arange(begin, min(begin + SPAN, size - 1))
            counts[at] = np.bitwise_count(self.marks(at))
        self.before = np.concatenate([[0], np.cumsum(counts)])  # ends in all words before each
        self.base = self.rank(starts)

    def marks(self, at: np.ndarray) -> np.ndarray:
        """The top bit of every byte that ends a unit, in the words ``at`` (in rising order)."""
        words, following = self.words[at], self.words[at + 1]
        joined, inner = letters(words), inner_bytes(words)
        # the mark of the byte after each byte: seven from this word, one from the next
        next_joined = (joined >> np.uint64(8)) | (letters(following) << np.uint64(56))
        next_inner = (inner >> np.uint64(8)) | (inner_bytes(following) << np.uint64(56))
        out = TOPS & ~(joined & next_joined) & ~next_inner
        lo, hi = np.searchsorted(self.last_word, at[0], "left"), np.searchsorted(self.last_word, at[-1], "right")
        place = np.searchsorted(at, self.last_word[lo:hi])
        here = at[np.minimum(place, len(at) - 1)] == self.last_word[lo:hi]
        np.bitwise_or.at(out, place[here], self.last_bit[lo:hi][here])
        end = int(self.ends[-1])
        out[at > end >> 3] = 0  # padding ends nothing
        out[at == end >> 3] &= np.uint64((1 << 8 * (end & 7)) - 1)
        return out

    def rank(self, place: np.ndarray) -> np.ndarray:
        """The number of unit ends before each byte place."""
        word, bits = place >> 3, (np.uint64(8) * (place & 7).astype(np.uint64))
        distinct, back = np.unique(word, return_inverse=True)
        inside = self.marks(distinct)[back] & ((np.uint64(1) << bits) - np.uint64(1))
        return self.before[word] + np.bitwise_count(inside)

    def counts(self) -> np.ndarray:
        """The number of units of each text."""
        return self.rank(self.ends) - self.base

    def select(self, text: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The byte place after the first k units of each given text."""
        out = self.starts[text].copy()
        some = np.flatnonzero(k > 0)
        if len(some):
            wanted = self.base[text[some]] + k[some]  # the ends are counted from 1
            word = np.searchsorted(self.before, wanted, "left") - 1
            nth = (wanted - self.before[word]).astype(np.uint64)
            distinct, back = np.unique(word, return_inverse=True)
            sums = (self.marks(distinct)[back] >> np.uint64(7)) * ONES  # ends up to each byte, at most 8
            reached = ((sums | TOPS) - nth * ONES) & TOPS
            out[some] = 8 * word + 8 - np.bitwise_count(reached) + 1
        return out


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts without nulls, and the places where they begin and end."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def transformed(texts: list[bytes], units: Units, draws: np.ndarray) -> tuple[list[bytes], list[str], list[int | None], list[int | None]]:
    """Outputs, forms, and code points of prefixes and middles, from the draws h1 to h4 of each text."""
    n = units.counts()
    first, second = draws[0] % (n + 1), draws[1] % (n + 1)
    marked = np.array([any(m in t for m in (b"<P>", b"<S>", b"<M>")) for t in texts], dtype=bool)
    plain = (n == 0) | marked | (draws[2] % 100 >= CHANGED)
    spm = draws[3] % 100 < SUFFIX_FIRST
    which = np.arange(len(texts))
    one = units.select(which, np.minimum(first, second)) - units.starts
    two = units.select(which, np.maximum(first, second)) - units.starts
    outputs: list[bytes] = []
    forms: list[str] = []
    chars: tuple[list[int | None], list[int | None]] = [], []
    for i, text in enumerate(texts):
        if plain[i]:
            outputs.append(text)
            forms.append("plain")
            chars[0].append(None)
            chars[1].append(None)
            continue
        prefix, middle, suffix = text[: one[i]], text[one[i] : two[i]], text[two[i] :]
        outputs.append(b"<S>" + suffix + b"<P>" + prefix + b"<M>" + middle if spm[i] else b"<P>" + prefix + b"<S>" + suffix + b"<M>" + middle)
        forms.append("spm" if spm[i] else "psm")
        chars[0].append(len(prefix.decode()))
        chars[1].append(len(middle.decode()))
    return outputs, forms, *chars


OUT = ("n", "form", "prefix_chars", "middle_chars", "output")


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED) -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output`` of every row of ``df``.

    ``n`` counts units of ``[A-Za-z]+|[^A-Za-z]``. The draws h1 to h4 are the first four groups of
    eight digits of the sha256 of ``seed:id``; they cut the text after min and max of h1 % (n + 1)
    and h2 % (n + 1) units and choose the form. A null text is empty; an empty text, and one that
    holds a marker, stays plain; prefix, middle and suffix may be empty. A null id is hashed as
    an empty text. Repeated rows give repeated rows, each the same; an empty table gives an empty
    result. Of ``df`` only the two named columns are read, whatever else it holds. A text is held
    whole by one task, with about three times its size in counts.
    """
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring(hashed, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *draws)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            column = batch.column(1)
            raw, offsets = buffer_of(column)
            units = Units(raw, offsets[:-1], offsets[1:])
            texts = [raw[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            found = np.stack([batch.column(2 + i).to_numpy() for i in range(4)])
            outputs, forms, prefix, middle = transformed(texts, units, found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(units.counts(), pa.int64()), pa.array(forms), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string())],
                names=["id", *OUT],
            )

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.select(F.col("id").alias(id_col), *OUT)


def restored(form: str = "form", output: str = "output"):
    """The exact text, from a row's form and output alone.

    A text with a marker stays plain, and no marker can begin inside a part and end in the next,
    so the first marker of each kind is the one that was put there.
    """
    out = F.col(output)

    def between(first: str, second: str):
        """The parts after the markers ``first``, ``second`` and the middle's, in that order."""
        a = F.instr(out, second)
        b = F.instr(out, MIDDLE)
        return (
            out.substr(F.lit(len(first) + 1), a - len(first) - 1),
            out.substr(a + len(second), b - a - len(second)),
            out.substr(b + len(MIDDLE), F.length(out)),
        )

    psm, spm = between(PREFIX, SUFFIX), between(SUFFIX, PREFIX)
    return (
        F.when(F.col(form) == "psm", F.concat(psm[0], psm[2], psm[1]))
        .when(F.col(form) == "spm", F.concat(spm[1], spm[2], spm[0]))
        .otherwise(out)
    )


def digests(done: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The outputs of ``fill_in_middle`` as digests, beside those of the texts rebuilt from them."""
    return done.select(
        id_col, "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored().cast("binary"), 256).alias("restored_sha256"),
    )


#: the digests of ``documents`` in SQL
SQL = """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), drawn AS (
  SELECT *, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS c2,
         CAST('0x' || h[17:24] AS BIGINT) % 100 AS c3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS c4
  FROM cut
), parts AS (
  SELECT *, array_to_string(units[1:least(c1, c2)], '') AS prefix,
         array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle,
         array_to_string(units[greatest(c1, c2) + 1:n], '') AS suffix,
         CASE WHEN n = 0 OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR c3 >= 90 THEN 'plain'
              WHEN c4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(body) AS restored_sha256
FROM parts
"""
