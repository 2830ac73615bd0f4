"""Sampled segmentations against all segmentations of small texts, and the trie in arrays against the pieces."""

from collections import Counter

import numpy as np

from stackleaf.llm import piece_lattice as P

WORDS = [b"a", b"b", b"c", b"ab", b"bc", b"abc", b"ca", b"cab", b" a", b" "]
SHARES = [5, 3, 2, 4, 2, 3, 1, 2, 1, 3]


def vocab():
    made = [(k, w, n) for k, (w, n) in enumerate(zip(WORDS, SHARES, strict=True))]
    made += [(100 + b, bytes([b]), 0.5) for b in range(256) if bytes([b]) not in WORDS]
    total = sum(n for *_, n in made)
    return [(i, w, n / total) for i, w, n in made]


def segmentations(text, pieces):
    if not text:
        return {(): 1.0}
    out = {}
    for i, w, p in pieces:
        if text.startswith(w):
            out |= {(i, *rest): p * q for rest, q in segmentations(text[len(w) :], pieces).items()}
    return out


def test_samples_follow_the_lattice():
    """Chi-square over all segmentations of each text; 20,000 draws, each by a row key of its own."""
    lattice, draws = P.Lattice(vocab()), 20_000
    for text in (b"abc", b"cabca", b"abcab cab", b"a\xffb ca"):
        every = segmentations(text, vocab())
        total = sum(every.values())
        got = Counter(tuple(x.tolist()) for x in lattice.sample([text] * draws, P.row_keys(list(range(draws)), 7)))
        assert set(got) <= set(every)
        want = {k: v / total * draws for k, v in every.items()}
        common = [k for k in every if want[k] >= 5]
        chi = sum((got[k] - want[k]) ** 2 / want[k] for k in common)
        assert chi < len(common) + 5 * np.sqrt(2 * len(common)) + 5
        rest = draws - sum(got[k] for k in common)
        assert abs(rest - (draws - sum(want[k] for k in common))) < 5 * np.sqrt(draws * 0.01) + 5


def test_trie_holds_the_pieces():
    r = np.random.default_rng(4)
    pieces = sorted({bytes(r.integers(97, 102, r.integers(1, 9)).astype(np.uint8)) for _ in range(3000)} | {bytes([b]) for b in range(256)})
    lattice = P.Lattice([(i, w, 1 / len(pieces)) for i, w in enumerate(pieces)])

    def find(w):
        at = 0
        for c in w:
            to = lattice.base[at] + c
            if lattice.check[to] != at:
                return -1
            at = to
        return lattice.ends[at]

    assert [find(w) for w in pieces] == list(range(len(pieces)))
    known = set(pieces)
    others = [bytes(r.integers(95, 104, r.integers(1, 10)).astype(np.uint8)) for _ in range(2000)]
    assert all(find(w) == -1 for w in others if w not in known)


def test_chunks_are_numbered_through_a_text():
    """A text cut into flushes of few chunks draws as in one; equal texts of different keys differ."""
    lattice = P.Lattice(vocab())
    text = b"abc cab ab\xfe" * 300
    one, two = (lattice.sample([text, b"", text], P.row_keys([1, None, 2], 3), most) for most in (40_000, 7))
    assert all(np.array_equal(a, b) for a, b in zip(one, two, strict=True)) and not np.array_equal(one[0], one[2])
    assert lattice.decode(one[0]) == text
