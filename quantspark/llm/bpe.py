"""BPE encoding and decoding by forced-boundary splitting.

A merge can only join two neighbouring symbols when some vocabulary token holds that pair.
Pairs that occur inside no token are therefore certain cuts: every word is split at them and
the fragments are encoded independently, then concatenated.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspark.llm.common import keeps, lists, pieces, released, texts_of

#: entries of a worker's word memory, and letters of the longest word kept there
MEMORY_WORDS = 300_000
MEMORY_LETTERS = 128
#: symbols up to which a fragment is merged by plain scans
SHORT_FRAGMENT = 64
#: marks without letters, digits or the apostrophe, which begins words of its own
PLAIN_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

#: white space as the vocabulary's patterns mean it (fixed values)
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """A word-end BPE vocabulary file: ids, merge ranks, special tokens and allowed pairs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.merged = [a + b for a, b in self.ranks]
        self.letters = dict(enumerate(byte_letters()))
        self.joins = {p for t in self.ids for s in [self.symbols(t)] for p in zip(s, s[1:])}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"].replace("\\s", SPACE))
        self.chunks = regex.compile(f"[^{SPACE}]+")
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def symbols(self, token: str) -> list[str]:
        """A token's letters; the word end belongs to the last one."""
        body = token.removesuffix(self.end)
        if body != token and body:
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def letters_of(self, word: str) -> list[str]:
        """A word's symbols before any merge: its bytes' letters, the last with the word end."""
        letters = list(word.encode("utf-8").decode("latin-1").translate(self.letters))
        letters[-1] += self.end
        return letters

    def fragments(self, letters: list[str]) -> list[list[str]]:
        """The symbols, cut wherever a pair occurs inside no token."""
        joins = self.joins
        cuts = [i for i, p in enumerate(zip(letters, letters[1:]), 1) if p not in joins]
        if not cuts:
            return [letters]
        return [letters[a:b] for a, b in zip([0, *cuts], [*cuts, len(letters)])]

    def merge(self, part: list[str]) -> list[int]:
        """Ids of one fragment: the lowest-ranked, then leftmost, pair merges first."""
        if len(part) > SHORT_FRAGMENT:
            return self.merge_long(part)
        rank, none = self.ranks.get, len(self.ranks)
        ranks = [rank(p, none) for p in zip(part, part[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            part[i] = self.merged[best]
            del part[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank((part[i], part[i + 1]), none)
            if i:
                ranks[i - 1] = rank((part[i - 1], part[i]), none)
        return [self.ids[s] for s in part]

    def merge_long(self, part: list[str]) -> list[int]:
        """The same by a heap over a linked list: n log n for very long fragments."""
        n, ranks = len(part), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p], i, p) for i, p in enumerate(zip(part, part[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if part[i] != pair[0] or j >= n or part[j] != pair[1]:
                continue  # one of the two has merged meanwhile
            part[i], part[j] = pair[0] + pair[1], ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (p := (part[a], part[b])) in ranks:
                    heapq.heappush(heap, (ranks[p], a, p))
        return [self.ids[s] for s in part if s]

    def word(self, word: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.merge, self.fragments(self.letters_of(word)))))


class Memory(dict):
    """Text between white space -> ids; bounded, since common words make up most of any text.

    No word of the pattern spans white space, so such chunks are encoded independently.
    """

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        v = self.vocabulary
        head = chunk.rstrip(PLAIN_MARKS)
        if len(head) < len(chunk) and head.isalpha():  # letters, then one run of marks: two words
            ids = self[head] + self[chunk[len(head) :]]
        elif chunk.isalpha():
            ids = v.word(chunk)
        else:
            ids = tuple(chain.from_iterable(map(v.word, v.words.findall(chunk))))
        if len(chunk) <= MEMORY_LETTERS:
            if len(self) >= MEMORY_WORDS:
                self.clear()
            self[chunk] = ids
        return ids


@lru_cache(maxsize=2)
def loaded(path: str) -> Memory:
    """One vocabulary and memory per Python worker, until it turns to another operator."""
    return Memory(Vocabulary(path))


def chunks(text: str, vocabulary: Vocabulary) -> list[str]:
    """What stands between white space, in NFC and lower case letter by letter (no final sigma)."""
    low = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
    if any(c in low for c in "\x1c\x1d\x1e\x1f"):  # white space to str.split only
        return vocabulary.chunks.findall(low)
    return low.split()


def encode_text(text: str, memory: Memory) -> list[int]:
    """Ids of a whole text; special tokens written out in it are those tokens."""
    v = memory.vocabulary
    out: list[int] = []
    for part in v.marks.split(text) if v.marks else [text]:
        if part in v.special:
            out.append(v.special[part])
        elif part:
            out.extend(chain.from_iterable(map(memory.__getitem__, chunks(part, v))))
    return out


def encode(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (array of int) of every row's whole text.

    Null and empty texts have no ids; repeated rows are encoded each; an empty table gives an
    empty result; other columns are neither read nor returned. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = loaded(vocab_path)
        keeps(__name__, loaded.cache_clear)
        for batch in pieces(batches, text_col):
            found = [encode_text(t, memory) for t in texts_of(batch, text_col)]
            values = np.fromiter(chain.from_iterable(found), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(values, list(map(len, found)))], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(released(run, __name__), f"`{id_col}` {kind}, ids array<int>")


def decode(df: DataFrame, vocab_path: str, id_col: str = "doc_id") -> DataFrame:
    """``encode``'s result with ``decoded``: the vocabulary names no decoder, so it is the tokens joined by one blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = loaded(vocab_path).vocabulary.tokens
        keeps(__name__, loaded.cache_clear)
        names = pa.array([tokens.get(i, "") for i in range(max(tokens) + 1)])
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = part.column(1)
                lengths = ids.value_lengths().to_pylist()
                words = lists(names.take(ids.flatten()), lengths)
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.compute.binary_join(words, " ")], names=[id_col, "ids", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, "ids").mapInArrow(released(run, __name__), f"`{id_col}` {kind}, ids array<int>, decoded string")


def digests(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and checksums of ``decode``'s result."""
    return df.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
