"""No link is lost: not where groups have several blocks, and not to the fingerprints."""

import random

import numpy as np
import pyarrow as pa
import pytest

from cairnfield.llm import nearcopies
from cairnfield.llm.common import staged

from .test_nearcopies import brute_kept


def bands(rng, count, length):
    """Texts in bands: each is linked to the next two of its band alone."""
    words, texts = [f"w{i}" for i in range(4000)], []
    for _ in range(count):
        band = rng.choices(words, k=100 + 4 * length)
        texts += [" ".join(band[i * 4 : i * 4 + 100]) for i in range(length)]
    return texts


def test_links_between_sets_that_did_not_go_on(spark, monkeypatch):
    """Labels that fit in one block after the first round, and are linked by others than their least sets."""
    monkeypatch.setattr(nearcopies, "MEMBERS", 8)
    rng = random.Random(3)
    texts = bands(rng, 25, 12) + bands(rng, 1, 40)
    clump = rng.choices([f"c{i}" for i in range(900)], k=100)
    texts += [" ".join([*clump[:k], f"x{i}", *clump[k:]]) for i, k in enumerate(rng.choices(range(100), k=30))]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_kept(dict(enumerate(texts)))
    assert len(want) == 27 and {r.doc_id for r in nearcopies.one_of_each(df).collect()} == want


def test_one_label_per_chain(spark, monkeypatch):
    """The exact check alone: a large label with a few sets beside it, of which some are linked to any of its sets."""
    monkeypatch.setattr(nearcopies, "MEMBERS", 16)
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 40, dtype="u8")
    sets = [np.append(base, rng.integers(0, 1 << 63, dtype="u8")) for _ in range(100)]
    tails = []
    for k in range(5):  # a hop from one of the clump's sets: its own links to the others fall short
        hop = np.concatenate([sets[k * 20][6:], rng.integers(0, 1 << 63, 2, dtype="u8")])
        tails += [hop, np.concatenate([hop[6:], rng.integers(0, 1 << 63, 1, dtype="u8")])]
    alone = [np.concatenate([base[:28], rng.integers(0, 1 << 63, 15, dtype="u8")]) for _ in range(6)]
    every = [np.unique(s) for s in sets + tails + alone]
    rows = [(1, int(i), s.tobytes()) for i, s in zip(rng.permutation(len(every)), every)]
    got = {r.id: r.label for r in nearcopies.exact(staged(spark.createDataFrame(rows, "root long, id long, set binary"), "members")).collect()}
    root = {i: i for _, i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    kept = {i: set(np.frombuffer(s, "<u8").tolist()) for _, i, s in rows}
    for i in kept:
        for j in kept:
            if i < j and 5 * len(kept[i] & kept[j]) >= 4 * len(kept[i] | kept[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert got == {i: find(i) for i in kept} and 1 < len(set(got.values())) <= 12


def test_between_blocks():
    """Only what lies in different blocks is compared, and within a single one all of it."""
    sets = {1: range(10), 2: range(11), 3: range(1, 11), 4: range(50, 60)}

    def edges(block, label):
        t = pa.table({"id": list(sets), "set": [np.array(s, "u8").tobytes() for s in sets.values()], "label": label, "block": block})
        return sorted(zip(*nearcopies.between(t).to_pydict().values()))

    assert edges([0, 0, 0, 0], [1, 2, 3, 4]) == [(1, 2), (1, 3), (2, 3)]
    assert edges([0, 0, 5, 5], [1, 2, 3, 4]) == [(1, 3), (2, 3)]
    assert edges([0, 0, 5, 5], [1, 1, 1, 4]) == []


@pytest.mark.parametrize(("seed", "both", "one", "two"), [(9812, 4, 0, 1), (18755, 4, 0, 1)])
def test_unlucky_fingerprints_are_linked(seed, both, one, two):
    """Sets whose bits differ more than most: the two of 20,000 drawn pairs of 4 and 5 shingles that differ by over 128."""
    x = np.random.default_rng(seed).integers(0, 1 << 63, both + one + two, dtype="u8")
    sets = np.sort(x[: both + one]), np.sort(np.concatenate([x[:both], x[both + one :]]))
    left, right = ((np.array([len(s)]), nearcopies.fingerprint(s)[None]) for s in sets)
    forest = nearcopies.Forest(2)
    nearcopies.join_near(forest, left, right, 0, 1)
    assert forest.roots().tolist() == [0, 0]
