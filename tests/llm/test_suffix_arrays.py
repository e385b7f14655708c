"""Longest matches by suffix arrays against brute force, in small shards and slices of pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from clickloom.llm import decontam


def brute_matches(docs, items, window):
    """(document, item, place in the item, place in the document, words) of all matches that nothing extends."""
    out = []
    for d, text in enumerate(docs):
        w = decontam.split_words(text)
        for i, (_, item) in enumerate(items):
            x = decontam.split_words(item)
            for s in range(len(x)):
                for p in range(len(w)):
                    if s and p and x[s - 1] == w[p - 1]:
                        continue
                    n = 0
                    while s + n < len(x) and p + n < len(w) and x[s + n] == w[p + n]:
                        n += 1
                    if n >= min(len(x), window):
                        out.append((d, i, s, p, n))
    return sorted(out)


@pytest.mark.parametrize("seed", range(60))
def test_longest_matches_equal_brute_force(monkeypatch, seed):
    draw = random.Random(seed)
    words = [b"a", b"b", b"c", b"d"][: draw.choice([1, 2, 4])]
    docs = [b" ".join(draw.choice([*words, *([b"Q"] if draw.random() < 0.3 else [])]) for _ in range(draw.randrange(40))) for _ in range(draw.randrange(1, 6))]
    items = [(str(k), b" ".join(draw.choice(words) for _ in range(draw.randrange(14)))) for k in range(draw.randrange(5))]
    window, pairs = draw.choice([1, 2, 4, 10]), draw.choice([1, 7, 1 << 20])
    monkeypatch.setattr(decontam, "SHARD_WORDS", draw.choice([5, 1 << 20]))
    find = decontam.SuffixShard.find
    monkeypatch.setattr(decontam.SuffixShard, "find", lambda shard, items: find(shard, items, pairs))
    got = []
    for rows, _, found in decontam.match_slice(iter([(pa.array([t.decode() for t in docs]), list(range(len(docs))))]), decontam.Items(items, window)):
        got += [(r, int(m["item_id"]), m["item_start"], m["doc_start"], m["n_words"]) for r, f in zip(rows, found, strict=True) for m in f]
    assert sorted(got) == brute_matches(docs, items, window)


@pytest.mark.parametrize("numbers", [[], [0, 0], [1] * 50, [1, 2, 1, 2, 1, 0, 1, 2, 1], [3, 0, 3, 0, 2, 3]])
def test_suffixes_are_sorted_whole(numbers):
    numbers = np.array(numbers, dtype=np.uint32)
    gaps = np.flatnonzero(numbers == 0)
    stop = np.append(gaps, len(numbers))[np.searchsorted(gaps, np.arange(len(numbers)))]
    got = decontam.suffix_array(numbers, stop).tolist()
    assert got == sorted(np.flatnonzero(numbers).tolist(), key=lambda p: (numbers[p : stop[p]].tolist(), p))
