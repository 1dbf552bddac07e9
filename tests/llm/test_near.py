"""Near-duplicates against all pairs."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import FOLDER, empty_frame, odd_frame, odd_rows, texts

from corpuslab.llm import dart_minhash as dm
from corpuslab.llm.components import components
from corpuslab.llm.queries import QUERIES


def grams(text):
    words = (text or "").lower().split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def weighted_jaccard(a, b):
    if not a and not b:
        return 1.0
    return sum((a & b).values()) / sum((a | b).values())


def classes_by_pairs(rows, least=0.8):
    """Smallest id per row, by comparing all pairs that share a five-gram."""
    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(set)
    for i, s in enumerate(sets):
        for g in s or [()]:
            holders[g].add(i)
    pairs = {(i, j) for h in holders.values() for i in h for j in h if i < j}
    for i, j in pairs:
        if weighted_jaccard(sets[i], sets[j]) >= least:
            parent[root(i)] = root(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[root(i)].append(i)
    return [
        min((rows[j][0] for j in members[root(i)] if rows[j][0] is not None), default=None)
        for i in range(len(rows))
    ]


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_near_query(spark, folder):
    rows = sorted(texts(folder).items())
    expected = dict(zip((r[0] for r in rows), classes_by_pairs(rows)))
    out = QUERIES["op10_dart_minhash"](spark, folder).collect()
    assert {r["doc_id"]: r["class_id"] for r in out} == expected
    sizes = Counter(expected.values())
    assert all(r["class_size"] == sizes[r["class_id"]] for r in out)
    assert sorted(r["doc_id"] for r in out if r["kept"]) == sorted(sizes)


def test_near_odd_rows(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    expected = Counter(zip((r[0] for r in rows), classes_by_pairs(rows)))
    out = dm.near_classes(odd_frame(spark)).collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in out) == expected
    kept = dm.drop_near(odd_frame(spark))
    assert kept.columns == odd_frame(spark).columns
    assert kept.count() == sum(r["kept"] for r in out)
    assert dm.near_classes(empty_frame(spark)).count() == 0


def test_chain_of_copies(spark):
    """A chain whose ends differ, and a crowd of copies that share bands without being similar."""
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    rows = []
    text = [word() for _ in range(200)]
    for _ in range(30):
        rows.append((len(rows), " ".join(text)))
        text = list(text)
        text[draw.randrange(200)] = word()
        text[draw.randrange(200)] = word()
    core = [word() for _ in range(60)]
    for _ in range(40):
        rows.append((len(rows), " ".join(core + [word() for _ in range(draw.randrange(5, 40))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["class_id"] for r in dm.near_classes(docs).collect()}
    assert [out[r[0]] for r in rows] == classes_by_pairs(rows)


def test_signatures_estimate_weighted_similarity():
    draw = np.random.default_rng(7)
    values = draw.integers(0, 2**63, 900).astype(np.uint64)
    counts = draw.integers(1, 4, 900)
    a = dm.units(np.repeat(values[:800], counts[:800]))
    b = dm.units(np.repeat(values[100:], counts[100:]))
    exact = dm.similarity(a, b)
    short = dm.units(values[:2])
    signed = dm.signatures([a, b, short, short, a[:0]], 4000)
    assert abs((signed[0] == signed[1]).mean() - exact) < 0.04
    assert (signed[2] == signed[3]).all() and not signed[4].any()
    # A signature does not depend on the other documents of a batch.
    assert (dm.signatures([b], 4000)[0] == signed[1]).all()


def test_units_are_weighted():
    a, b = np.array([5, 5, 5, 9], np.uint64), np.array([5, 5, 9, 9], np.uint64)
    assert dm.similarity(dm.units(a), dm.units(b)) == pytest.approx(3 / 5)


def test_components(spark):
    draw = random.Random(8)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)]
    links += [(draw.randrange(200, 400), draw.randrange(200, 400)) for _ in range(90)] + [(7, 7), (2, 1)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == {
        x: root(x) for x in parent if root(x) != x
    }
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
