import random
import tracemalloc

import numpy as np
import pandas as pd

from dossia.llm import toxicity
from dossia.llm.common import give_back


def test_memory_of_a_fit_and_of_word_sums():
    """A part's numbers are held about twice, not five times; n-grams of many words are looked at in runs of words, which changes no sum."""
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=8)) for _ in range(60)) for _ in range(400)]
    ratio = np.random.default_rng(1).normal(size=toxicity.BUCKETS)
    rows = pd.DataFrame({"text": texts, "label": [n % 2 for n in range(len(texts))]})
    held = sum(len(np.unique(toxicity.ngrams(list(toxicity.distinct_words(t)))[0])) for t in texts)
    words = sorted(set().union(*map(toxicity.distinct_words, texts)))
    at, ends = toxicity.ngrams(words)
    want = np.array([ratio[at[a:b]].sum() for a, b in zip([0, *ends[:-1]], ends, strict=True)])
    tracemalloc.start()
    try:
        toxicity._fit_part(ratio, rows)
        fit = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        got = toxicity.word_sums(words * 5, ratio)
        sums = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert np.allclose(got, np.tile(want, 5), atol=1e-9)
    assert fit < 70 * held + (8 << 20) and sums < 40 << 20, (fit / held, sums >> 20)


def test_freed_memory_goes_back_to_the_system():
    def resident() -> int:
        with open("/proc/self/status") as f:
            return next(int(line.split()[1]) for line in f if line.startswith("RssAnon")) >> 10

    # Small blocks below one that stays: the allocator keeps them until it is told.
    blocks = [bytes(50_000) for _ in range(4000)]
    last = bytes(50_000)
    before = resident()
    del blocks
    give_back()
    assert last and before - resident() > 100
