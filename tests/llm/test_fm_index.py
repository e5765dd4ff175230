import random

import numpy as np
import pytest

from cadenza.llm import decontaminate as dec
from cadenza.llm.fm_index import FMIndex, suffix_order


@pytest.mark.parametrize("seed", range(8))
def test_suffix_order_and_search_match_brute_force(seed):
    rnd = random.Random(seed)
    sigma = rnd.choice([1, 2, 5, 40])
    seqs = [[rnd.randint(1, sigma) for _ in range(rnd.randint(0, 30))] for _ in range(20)]
    seqs += seqs[:5]
    seq = np.array([x for s in seqs for x in (*s, 0)], np.int32)
    places = list(range(len(seq)))

    def suffix(i):
        return tuple(seq[i : i + list(seq[i:]).index(0)])

    assert suffix_order(seq, 31).tolist() == sorted(places, key=lambda i: (suffix(i), i))
    index = FMIndex(seq, sigma, 31, step=4)
    for _ in range(50):
        p = [rnd.randint(1, sigma) for _ in range(rnd.randint(1, 4))]
        rows = np.zeros((1, 6), np.int32)
        rows[0, : len(p)] = p
        lo, hi = index.search(rows, np.array([len(p)]))
        assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == [i for i in places if tuple(seq[i : i + len(p)]) == tuple(p)]


def brute(text, items, window):
    own = dec.words(text)
    hit, found = set(), set()
    for k, (_, t) in enumerate(items):
        w = dec.words(t)
        for at in range(max(1, len(w) - window + 1) if w else 0):
            p = w[at : at + window]
            for i in range(len(own) - len(p) + 1):
                if own[i : i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    found.add(k)
    return hit, sorted(found)


@pytest.mark.parametrize("limit", [7, 40, 1 << 19])
def test_hits_match_brute_force(limit):
    rnd = random.Random(limit)
    vocab = ["a", "B", "cé", "d1", "zz"]
    text = lambda n: " ".join(rnd.choice(vocab) + rnd.choice(["", ".", ",\n"]) for _ in range(n)).encode()
    items = [(str(k), text(rnd.randint(1, 9))) for k in range(12)] + [("n", None), ("e", b""), ("e2", b"...")]
    items.append(items[0])
    texts = [text(rnd.randint(0, 60)) for _ in range(30)] + [None, b"", b"?!", text(400)]
    what = dec.phrases(items, 4)
    for t, (spans, found) in zip(texts, dec.hits(texts, what, 4, limit), strict=True):
        hit, own = brute(t, items, 4)
        assert {x for a, b in zip(spans[::2], spans[1::2], strict=True) for x in range(a, b)} == hit or not t
        assert found == own


def test_cut_leaves_the_rest():
    text = "One, two three. Four five! Six".encode()
    assert dec.cut(text, [1, 3, 4, 5]) == b"One, . Four ! Six"
    assert dec.merge([(5, 7), (0, 3), (3, 4), (6, 9)]) == [(0, 4), (5, 9)]
