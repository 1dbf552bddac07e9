"""Licence scan, quality rules, shards and exact copies against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from helpers import FOLDER, empty_frame, odd_frame, odd_rows, texts

from corpuslab.llm import host_rules, label_shards, licenses, trie_dedup
from corpuslab.llm.queries import ORACLE, QUERIES

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def base_places(text):
    words = WORDS.findall(lowered(text))
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        parts = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(parts)] == parts:
                places.append(i)
                labels.add(label)
    return len(words), places, labels


def check_scan(row, text):
    n, places, labels = base_places(text)
    assert (row["n_words"], row["n_base"]) == (n, len(places))
    assert row["first_word"] == min(places, default=None)
    assert row["last_word"] == max(places, default=None)
    assert row["base_labels"] == ",".join(sorted(labels))
    assert labels <= set(filter(None, row["labels"].split(",")))
    assert 0 <= row["score"] <= 1


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_license_query(spark, folder):
    rows = {r["doc_id"]: r for r in QUERIES["op2_license_scan"](spark, folder).collect()}
    assert len(rows) == len(texts(folder))
    for doc_id, text in texts(folder).items():
        check_scan(rows[doc_id], text)


def test_license_odd_rows(spark):
    rows = licenses.scan_licenses(odd_frame(spark)).collect()
    assert len(rows) == len(odd_rows())
    by_key = {(r["doc_id"], r["n_words"]): r for r in rows}
    for doc_id, text, *_ in odd_rows():
        check_scan(by_key[doc_id, len(WORDS.findall(lowered(text)))], text)
    assert licenses.scan_licenses(empty_frame(spark)).count() == 0


@pytest.mark.parametrize(
    "text, labels, freedom",
    [
        ("SPDX-License-Identifier: MIT", {"mit"}, 1.0),
        ("// SPDX-License-Identifier: (MIT OR GPL-2.0-only)\nint x;", {"mit", "gpl"}, 1.0),
        ("SPDX-License-Identifier: MIT AND GPL-3.0+", {"mit", "gpl"}, 0.2),
        ("SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0", {"gpl"}, 0.6),
        ("SPDX-License-Identifier: mit or gpl-2.0 and lgpl-2.1", {"mit", "gpl", "lgpl"}, 1.0),
        ("SPDX-License-Identifier: mit or (", {"mit"}, 1.0),
        ("SPDX-License-Identifier: )", set(), None),
        ('license-expression = "BSD-3-Clause"', {"bsd"}, 1.0),
        ("nothing of the kind", set(), None),
    ],
)
def test_expressions(text, labels, freedom):
    found = licenses.scan_text(text)
    assert found["labels"] == labels
    assert found["freedom"] == (None if freedom is None else pytest.approx(freedom))


@pytest.mark.parametrize("symbols", [["and"], ["mit", "mit"], ["(", "mit"], ["mit", ")"], [], ["mit", "or"]])
def test_bad_expressions(symbols):
    with pytest.raises(licenses.BadExpression):
        licenses.postfix(symbols)


def test_postfix_binds_as_stated():
    symbols = "a or b and c with x".split()
    assert licenses.postfix(symbols) == "a b c x with and or".split()


def measured(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i, t in enumerate(zip(words, words[1:], words[2:])):
        if seen[t] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered))


def test_quality_odd_rows(spark):
    rows = host_rules.judge(odd_frame(spark)).collect()
    found = Counter(
        (r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        for r in rows
    )
    assert found == Counter((r[0], *measured(r[1])) for r in odd_rows())
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert host_rules.judge(empty_frame(spark)).count() == 0
    assert host_rules.keep_good(empty_frame(spark)).columns == empty_frame(spark).columns


@pytest.mark.parametrize(
    "text",
    [
        "A license expression is a short text.",
        "No license expression of any kind",
        "SPDX-License-Identifier: see LICENSE file",
        "SPDX-License-Identifier MIT",
        "license expression: none",
        "license-expression = (unclear",
    ],
)
def test_prose_after_a_tag_is_no_licence(text):
    found = licenses.scan_text(text)
    assert found["labels"] == set() and found["expressions"] == [] and found["freedom"] is None


def test_identifiers_after_a_tag():
    labels = lambda text: licenses.scan_text(text)["labels"]
    assert labels("SPDX-License-Identifier: MIT OR see the file") == {"mit"}
    assert labels('"license-expression": "LicenseRef-Own-1 AND OFL-1.1"') == {"licenseref-own-1", "ofl-1.1"}
    assert labels("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0") == {"gpl"}
    assert labels("SPDX-License-Identifier: Zlib OR (PostgreSQL AND 0BSD)") == {"zlib", "postgresql", "0bsd"}


def test_host_verdicts(spark):
    good = " ".join(f"word{i}" for i in range(60))
    soft = good + " # # # # # # # #"
    rows = [(i, good, "en", "good", 1) for i in range(40)]
    rows += [(100 + i, "short", "en", "bad", 1) for i in range(30)]
    rows += [(200, soft, "en", "bad", 1), (201, good, "en", "bad", 1), (202, soft, "en", "good", 1)]
    rows += [(300, "short", "en", "tiny", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"]: r["kept"] for r in host_rules.judge(docs).collect()}
    assert all(kept[i] for i in range(40)) and not any(kept[100 + i] for i in range(30))
    # Of a rejected host, a document that passes every rule stays.
    assert (kept[200], kept[201], kept[202], kept[300]) == (False, True, True, False)
    assert sorted(r["doc_id"] for r in host_rules.keep_good(docs).collect()) == [*range(40), 201, 202]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    for folder in (FOLDER, "/root/testdata/sf0.01"):
        connection = duckdb.connect()
        for table in ("documents", "pages", "benchmark", "labels"):
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
        result = QUERIES[name](spark, folder)
        cursor = connection.execute(ORACLE[name])
        names = [c[0] for c in cursor.description]
        assert sorted(names) == sorted(result.columns)
        expected = Counter(tuple(r) for r in cursor.fetchall())
        assert Counter(tuple(r[c] for c in names) for r in result.collect()) == expected
        connection.close()


def check_shards(rows, shards=8):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    for found in slots.values():
        assert sorted(found) == list(range(len(found)))
    sizes = [len(slots.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_shards_query(spark, folder):
    rows = QUERIES["op8_label_shards"](spark, folder).collect()
    check_shards(rows)
    known = texts(folder)
    by_text = defaultdict(Counter)
    for r in rows:
        raw = (known[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        by_text[raw][r["shard"]] += 1
    assert len(rows) == len(known)
    assert sum(len(c) > 1 for c in by_text.values()) == 0


def test_large_group_is_split_at_shard_ends(spark):
    rows = [(i, "same" if i < 300 else f"own {i % 350}", "en", "a", 1) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = label_shards.shard_documents(docs).collect()
    check_shards(out)
    shards = defaultdict(Counter)
    for r in out:
        shards[rows[r["doc_id"]][1]][r["shard"]] += 1
    # 300 rows are cut into four parts with a home each (shards hold 100, parts are up to 3/4 of a
    # shard); a random deal would leave 150 of them in four shards.
    assert sum(sum(c.values()) - max(c.values()) for t, c in shards.items() if t != "same") <= 60
    assert sum(n for _, n in shards["same"].most_common(4)) >= 225


def test_shards_odd_rows(spark):
    rows = label_shards.shard_documents(odd_frame(spark)).collect()
    assert len(rows) == len(odd_rows())
    check_shards(rows)
    assert label_shards.shard_documents(empty_frame(spark)).count() == 0


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("budget", [1 << 25, 300])
def test_exact_odd_rows(spark, budget):
    rows = trie_dedup.exact_owners(odd_frame(spark), budget=budget).collect()
    groups = defaultdict(list)
    for doc_id, text, *_ in odd_rows():
        groups[plain(text)].append(doc_id)
    expected = Counter()
    for ids in groups.values():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            expected[i, keep, len(ids)] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in rows) == expected
    assert sum(r["kept"] for r in rows) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in rows if r["kept"])
    assert trie_dedup.exact_owners(empty_frame(spark)).count() == 0


def test_drop_copies(spark):
    kept = trie_dedup.drop_copies(odd_frame(spark))
    assert kept.columns == odd_frame(spark).columns
    found = [plain(r["text"]) for r in kept.collect()]
    assert sorted(found) == sorted({plain(r[1]) for r in odd_rows()})


def test_trie_keeps_every_key():
    import random

    draw = random.Random(4)
    keys = [bytes(draw.choice(b"ab") for _ in range(draw.randint(0, 12))) for _ in range(3000)]
    trie = trie_dedup.PatriciaTrie(list)
    for k in keys:
        trie.terminal(k).append(k)
    found = dict(trie.items())
    assert {k: len(v) for k, v in found.items()} == Counter(keys)
    spilled = []
    while trie.below:
        spilled += [k for k, _ in trie.spill()]
    assert sorted(spilled) == sorted(set(keys) - {b""})
