"""Language identification by rank-order profiles.

A profile lists a language's most frequent letter n-grams by rank. A document's own most
frequent n-grams are compared with each profile by the out-of-place distance: the sum of the
rank differences, with the greatest difference for an n-gram that the profile lacks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantspark.llm.common import held_out, pieces, texts_of

#: n-grams of a profile, of a language and of a document
PROFILE = 400
#: letters read at once of a long text; neighbouring spans overlap so that no n-gram is lost
SPAN = 1 << 20
#: n-grams of one language that a task holds before it passes them on
HELD_GRAMS = 1 << 20
#: three code points of 21 bits fit one 64-bit number, so n-grams have one to three letters
BITS = 21
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's n-grams of one to three letters, packed, and their counts.

    Everything but letters counts as one blank; a blank may begin or end an n-gram, so that
    word beginnings and ends count as such, but stands in none alone or inside.
    """
    code = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
    found = []
    for start in range(0, max(len(code), 1), SPAN):
        span = code[max(0, start - 2) : start + SPAN].astype(np.int64)
        lead = min(start, 2)  # letters read before; n-grams that end there are counted already
        letter = letter_table()[span]
        if start == 0:
            span, letter, lead = np.concatenate([[0], span]), np.concatenate([[False], letter]), 0
        if start + SPAN >= len(code):
            span, letter = np.concatenate([span, [0]]), np.concatenate([letter, [False]])
        span[~letter] = 32
        one = span[lead:][letter[lead:]]
        two = (span[:-1] << BITS) | span[1:]
        two = two[(letter[:-1] | letter[1:]) & (np.arange(1, len(span)) >= lead)]
        three = (span[:-2] << 2 * BITS) | (span[1:-1] << BITS) | span[2:]
        three = three[letter[1:-1] & (np.arange(2, len(span)) >= lead)]
        keys = np.sort(np.concatenate([one, two, three]))
        if len(keys):
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            found.append((keys[first], np.diff(np.append(first, len(keys)))))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return found[0] if len(found) == 1 else merged(*map(np.concatenate, zip(*found)))


def ranked(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most frequent n-grams, ties to the smaller one."""
    if len(keys) > 4 * PROFILE:  # all that tie with the last rank stay until the sort
        least = np.partition(counts, len(counts) - PROFILE)[len(counts) - PROFILE]
        keep = counts >= least
        keys, counts = keys[keep], counts[keep]
    return keys[np.lexsort((keys, -counts))][:PROFILE]


def gram_counts(df: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """``lang, gram, n`` over all rows with a language, summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = defaultdict(list)
        size: dict[str, int] = defaultdict(int)

        def out(lang: str) -> pa.RecordBatch:
            keys, counts = held.pop(lang)[0]
            del size[lang]
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(counts)], names=["lang", "gram", "n"])

        for batch in pieces(batches, text_col):
            langs = batch.column(batch.schema.get_field_index(lang_col)).to_pylist()
            for lang, text in zip(langs, texts_of(batch, text_col)):
                found = ngrams(text)
                if not len(found[0]):
                    continue
                held[lang].append(found)
                size[lang] += len(found[0])
                if size[lang] >= 2 * HELD_GRAMS:
                    held[lang] = [merged(*map(np.concatenate, zip(*held[lang])))]
                    size[lang] = len(held[lang][0][0])
                    if size[lang] >= HELD_GRAMS:
                        yield out(lang)
        for lang in list(held):
            held[lang] = [merged(*map(np.concatenate, zip(*held[lang])))]
            yield out(lang)

    part = df.where(F.col(lang_col).isNotNull()).select(lang_col, text_col)
    return part.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(df: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, list[int]]:
    """Each language's most frequent n-grams by rank, counted over all rows of ``df``.

    At most PROFILE n-grams per distinct language reach the driver.
    """
    by = [F.col("n").desc(), F.col("gram")]
    counts = gram_counts(df, lang_col, text_col)
    for part in (["lang", F.pmod(F.xxhash64("gram"), F.lit(32))], ["lang"]):  # two levels: no task ranks all of a language
        counts = counts.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*by))).where(F.col("rank") <= PROFILE)
    out: dict[str, list[int]] = defaultdict(list)
    for row in counts.orderBy("lang", "rank").collect():
        out[row.lang].append(row.gram)
    return dict(out)


class Profiles:
    """All profiles as one table: n-gram -> its rank in each language."""

    def __init__(self, by_lang: dict[str, list[int]]):
        self.langs = sorted(by_lang, key=lambda s: s.encode())
        self.grams = np.unique(np.array([g for v in by_lang.values() for g in v], dtype=np.int64))
        self.ranks = np.full((len(self.langs), len(self.grams) + 1), -1, dtype=np.int64)  # the last column: n-grams of no profile
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.grams, by_lang[lang])] = np.arange(len(by_lang[lang]))

    def predict(self, text: str) -> tuple[str, float]:
        own = ranked(*ngrams(text))
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, own)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != own)] = len(self.grams)
        theirs = self.ranks[:, at]
        apart = np.where(theirs < 0, PROFILE, np.abs(theirs - np.arange(len(own)))).sum(axis=1)
        best = int(np.argmin(apart))  # ties to the first language by code point
        return self.langs[best], 1.0 - float(apart[best]) / (PROFILE * len(own))


def identify(df: DataFrame, by_lang: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score`` of every row's whole text; no shuffle.

    score: one less the distance as a share of the greatest one. Null texts, texts without a
    letter and an empty set of profiles give ``und`` and 0. Repeated rows are judged each; an
    empty table gives an empty result; other columns are neither read nor returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(by_lang)
        for batch in pieces(batches, text_col):
            found = [model.predict(t) for t in texts_of(batch, text_col)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=[id_col, "lang_pred", "score"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def language_of_documents(docs: DataFrame) -> DataFrame:
    """Learns from the rows that are not held out, then judges every row."""
    learnt = profiles(docs.where(~held_out()))
    return identify(docs, learnt).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
