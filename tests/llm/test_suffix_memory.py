"""One suffix array and what it takes: a worker keeps the memory of its peak."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np

from quantspark.llm.suffix import LENGTH, repeated


def test_an_array_takes_few_bytes_a_symbol():
    rng = random.Random(5)
    texts = [bytes(rng.choices(b"abcdefgh \x00\xff", k=rng.randint(LENGTH, 399))) for _ in range(900)]
    texts += [t[: rng.randint(LENGTH, len(t))] for t in texts[:300]]
    starts = [len(t) - LENGTH + 1 for t in texts]
    tracemalloc.start()
    found = repeated(texts, np.array(starts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 * sum(len(t) + 1 for t in texts)
    times = {}
    for text, n in zip(texts, starts):
        for i in range(n):
            times[text[i : i + LENGTH]] = times.get(text[i : i + LENGTH], 0) + 1
    for text, n, flags in zip(texts, starts, found):
        assert flags.tolist() == [times[text[i : i + LENGTH]] > 1 for i in range(n)]
