"""Merkle proofs and fill-in-the-middle examples by hand."""

import hashlib
import random
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest
from helpers import FOLDER, SCHEMA, empty_frame, odd_frame, odd_rows

from corpuslab.llm import infilling, manifest
from corpuslab.llm.queries import QUERIES

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    fields = [row[k] for k in ("doc_id", "source", "lang", "n_chars", "text")]
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def tree(leaves):
    """(root, for every leaf its runs: (place, run)) of one tree, level by level."""
    paths, where, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        runs = [nodes[k : k + 3] for k in range(0, len(nodes), 3)]
        for i, at in enumerate(where):
            paths[i].append((at % 3, runs[at // 3]))
            where[i] = at // 3
        nodes = [digest("".join(run)) for run in runs]
    return nodes[0], paths


def by_hand(rows):
    sources = {}
    for row in rows:
        sources.setdefault(row["source"], []).append(row)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    parts = {}
    for s in order:
        own = sorted(sources[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        parts[s] = (own, *tree([leaf(r) for r in own]))
    root, above = tree([parts[s][1] for s in order])
    out = []
    for s, over in zip(order, above):
        own, subroot, paths = parts[s]
        for row, path in zip(own, paths):
            path = path + over
            proof = digest("".join(d for place, run in path for k, d in enumerate(run) if k != place))
            checked = dict(row)
            if row["doc_id"] is not None and row["text"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0:
                checked["text"] = row["text"].replace("\n", "")
            node = leaf(checked)
            for place, run in path:
                node = digest("".join([*run[:place], node, *run[place + 1 :]]))
            out.append((row["doc_id"], leaf(row), subroot, root, proof, node, node == root))
    return sorted(out, key=str)


def rows_of(df):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_manifest_query(spark, folder):
    rows = pq.read_table(f"{folder}/documents.parquet").to_pylist()
    found = rows_of(QUERIES["op12_merkle_manifest"](spark, folder))
    assert found == by_hand(rows)
    assert {r[-1] for r in found} == {True, False}


@pytest.mark.parametrize("sizes", [(1,), (3,), (4, 1, 9, 10), (27, 28, 82, 2, 1, 1), tuple([1] * 30)])
def test_blocks_are_appended_to_one_tree(spark, sizes):
    """Small blocks, so that trees take several rounds; the largest source first and last."""
    rows = [(k * 1000 + i, f"t{i}\n{k}", "en", f"s{k:02d}" if k else None, i) for k, n in enumerate(sizes) for i in range(n)]
    random.Random(5).shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    expected = by_hand([dict(zip(NAMES, r)) for r in rows])
    assert rows_of(manifest.verify_manifest(docs, levels=1)) == expected
    assert rows_of(manifest.verify_manifest(docs, levels=2)) == expected


def test_manifest_odd_rows(spark):
    rows = [dict(zip(NAMES, r)) for r in odd_rows()]
    assert rows_of(manifest.verify_manifest(odd_frame(spark))) == by_hand(rows)
    clashing = odd_frame(spark).selectExpr("*", "1 AS tree", "2 AS place", "3 AS digest", "4 AS _rank", "5 AS checked")
    assert rows_of(manifest.verify_manifest(clashing)) == by_hand(rows)
    assert manifest.verify_manifest(empty_frame(spark)).count() == 0


def example(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by slices of code points."""
    h = digest(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or h3 % 100 >= 90 or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    return n, "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]


def test_infilling_query(spark):
    known = pq.read_table(f"{FOLDER}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    found = {r["doc_id"]: r for r in QUERIES["op13_fill_in_middle"](spark, FOLDER).collect()}
    assert len(found) == len(known)
    for row in known:
        r, text = found[row["doc_id"]], row["text"] or ""
        n, form, prefix, middle, output = example(row["doc_id"], text)
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, prefix, middle)
        assert (r["output_sha256"], r["restored_sha256"]) == (digest(output), digest(text))
    assert {r["form"] for r in found.values()} == {"plain", "psm", "spm"}


def test_infilling_odd_rows(spark):
    rows = odd_rows() + [(50 + k, t, "en", "a", 1) for k, t in enumerate(["x<P>y", "a<", "<S", "<M<M", "\n\r ", "é<"] * 9)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n", "2 AS form", "3 AS output")
    found = infilling.infill(docs).collect()
    get = lambda r: (r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])
    expected = Counter((r[0], *example(r[0], r[1] or "")) for r in rows)
    assert Counter(map(get, found)) == expected
    assert all(infilling.restore(r["output"], r["form"]) in {x[1] or "" for x in rows if x[0] == r["doc_id"]} for r in found)
    digests = infilling.infill_digest(docs).collect()
    assert Counter(r["restored_sha256"] for r in digests) == Counter(digest(r[1] or "") for r in rows)
    assert infilling.infill(empty_frame(spark)).count() == 0


def test_other_units(spark):
    """Words with the space after them as units: cuts fall between words."""
    docs = spark.createDataFrame([(i, "one two  three four five") for i in range(40)], "doc_id long, text string")
    rows = infilling.infill(docs, unit=r"\S+\s*").collect()
    starts = {0, 4, 9, 15, 20, 24}
    assert {r["n"] for r in rows} == {5}
    assert all(r["form"] == "plain" or {r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]} <= starts for r in rows)
    with pytest.raises(ValueError):
        infilling.Infiller("a").cut("ab", 1)
