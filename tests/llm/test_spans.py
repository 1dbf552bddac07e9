"""Personal data, repeated sentences and the pipeline against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from helpers import FOLDER, SCHEMA, empty_frame, odd_frame, odd_rows, texts
from test_near import classes_by_pairs
from test_scans import measured, plain

from corpuslab.llm import disclosure, sentence_spans
from corpuslab.llm.queries import QUERIES

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TRICKY = [
    "a@b.c@d.e x_y@z.q%w@v.u 1.2.3.4.5.6.7.8 256.1.1.1 0255.001.1.1 1.2.3",
    "4111 1111 1111 1111, 4111-1111-1111-1112 and +1 (555) 010-9999 +1 +12 34 5 +123456789012345678",
    "é\U0001f600 me@x.yz 10.0.0.1, +44 20 7946 0958.",
    "a" * 5000 + "@" + "b.c" * 3000 + " " + "1" * 9000 + ".2.3.4 " + "." * 500 + "@",
    "@@..@.a@b. 1.1.1.1",
    "",
]


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def base_spans(text):
    found = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        found += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text or "") if valid(kind, m.group())]
    return sorted(found)


def listed(spans):
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)


def check_digest(row, text):
    spans = base_spans(text)
    counts = Counter(s[3] for s in spans)
    assert [row[f"n_{k}"] for k in BASE] == [counts[k] for k in BASE]
    assert row["base_sha256"] == hashlib.sha256(listed(spans).encode()).hexdigest()
    others = [s for s in row["spans"].split(",") if s and s.split(":")[0] in ("general", "removed")]
    assert [s for s in row["spans"].split(",") if s and s not in others] == [s for s in listed(spans).split(",") if s]


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_disclosure_query(spark, folder):
    rows = {r["doc_id"]: r for r in QUERIES["op5_disclosure"](spark, folder).collect()}
    known = texts(folder)
    assert len(rows) == len(known)
    for doc_id, text in known.items():
        check_digest(rows[doc_id], text)


def test_disclosure_odd_rows(spark):
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(TRICKY)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for r in disclosure.span_digest(docs).collect():
        check_digest(r, TRICKY[r["doc_id"]])
    out = disclosure.span_digest(odd_frame(spark)).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in odd_rows())
    assert disclosure.span_digest(empty_frame(spark)).count() == 0
    cleaned = disclosure.sanitise(odd_frame(spark))
    assert cleaned.columns == odd_frame(spark).columns
    assert Counter(r["text"] for r in cleaned.collect()) == Counter(r[1] for r in odd_rows())


def test_disclosing_words(spark):
    filler = [f"plain text number{i} says nothing at all" for i in range(60)]
    rows = [(i, t) for i, t in enumerate(filler)]
    rows += [(100 + i, f"{w} ask Zebedee Quux at zq@mail.example.com, {w} please") for i, w in enumerate(["first", "second", "third"])]
    rows += [(200 + i, f"ask someone else please {i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    total, n_e = len(rows), 3
    frequency = Counter(w for _, t in rows for w in {x.lower() for x in re.findall(r"[0-9A-Za-z]+", t)})
    share = lambda n_et, w: math.log2(n_et * total / (n_e * frequency[w])) / math.log2(total / n_e)
    assert share(3, "zebedee") == 1 and share(3, "please") < 0.8
    found = {r["doc_id"]: r["spans"] for r in disclosure.span_digest(docs).collect()}
    text = dict(rows)[100]
    marked = {text[int(a) : int(b)]: k for k, a, b in (s.split(":") for s in found[100].split(","))}
    assert marked == {"Zebedee": "removed", "Quux": "removed", "zq@mail.example.com": "email"}
    assert not any(found[i] for i in range(60)) and not found[200]
    cleaned = {r["doc_id"]: r["text"] for r in disclosure.sanitise(docs).collect()}
    assert cleaned[100] == "first ask   at [EMAIL], first please" and cleaned[5] == filler[5]


def test_every_kind_alone_is_masked(spark):
    """Texts that hold one identifier meet the edits; near misses and texts without any stay."""
    texts = {
        1: ("to a@b.org", "to [EMAIL]"),
        2: ("at 10.0.0.1", "at [IP]"),
        3: ("no 4242-4242-4242-4242", "no [CARD]"),
        4: ("call +49 (30) 123456", "call [PHONE]"),
        5: ("no 4242-4242-4242-4243", "no 4242-4242-4242-4243"),
        6: ("plain words", "plain words"),
        7: ("", ""),
        8: (None, None),
    }
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, (t, _) in texts.items()], SCHEMA)
    out = disclosure.sanitise(docs)
    assert out.schema.names == docs.schema.names
    rows = out.collect()
    assert {r["doc_id"]: r["text"] for r in rows} == {i: clean for i, (_, clean) in texts.items()}
    assert len(rows) == len(texts) and all(r["n_chars"] == len(r["text"] or "") for r in rows)


def test_masks_cover_overlaps(spark):
    text = "x +1 4111111111111111 y é 10.0.0.1z@q.rs end"
    out = disclosure.sanitise(spark.createDataFrame([(1, text, "en", "a", len(text))], SCHEMA)).first()
    covered = set()
    for start, _, end, _ in base_spans(text):
        covered |= set(range(start, end))
    rest = "".join(c for i, c in enumerate(text) if i not in covered)
    assert re.sub(r"\[[A-Z]+\]", "", out["text"]) == rest
    assert out["n_chars"] == len(out["text"])


def removed_by_hand(rows):
    """Sentences under a span that a smaller id, or the same text before, holds."""
    parts = {i: [" ".join(t[a:b].split()) for a, b in sentence_spans.sentences(t or "")] for i, t in rows}
    owner, first = {}, {}
    keys = defaultdict(list)
    for i, s in sorted(parts.items()):
        for a, b in sentence_spans.spans([len(x.split()) for x in s]):
            key = tuple(s[a : b + 1])
            keys[i].append((a, b, key))
            owner.setdefault(key, i)
            first.setdefault((i, key), a)
    return {
        i: {k for a, b, key in found if owner[key] != i or first[i, key] != a for k in range(a, b + 1)}
        for i, found in keys.items()
    }


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_sentence_query(spark, folder):
    known = texts(folder)
    expected = removed_by_hand(known.items())
    rows = QUERIES["op7_sentence_spans"](spark, folder).collect()
    assert len(rows) == len(known)
    for r in rows:
        text = known[r["doc_id"]]
        gone = expected.get(r["doc_id"], set())
        bounds = sentence_spans.sentences(text)
        assert (r["n_sentences"], r["n_removed"]) == (len(bounds), len(gone))
        left = [text[a:b] for i, (a, b) in enumerate(bounds) if i not in gone]
        assert r["text"].split() == " ".join(left).split()


def test_repeated_passage(spark):
    passage = " ".join(f"Sentence number {i} of a passage that many pages share with others." for i in range(6))
    own = lambda i: f"This page {i} has its own words, quite unlike those of page {i * 7}."
    rows = [(i, f"{own(i)} {passage} {own(i + 50)}") for i in range(30)] + [(99, own(99))]
    out = {r["doc_id"]: r for r in sentence_spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0]["text"] == rows[0][1] and out[99]["n_removed"] == 0
    for i in range(1, 30):
        assert out[i]["text"] == f"{own(i)} {own(i + 50)}" and out[i]["n_removed"] == 6
        a, b = map(int, out[i]["removed"].split(":"))
        assert rows[i][1][a:b].strip() == passage


def test_sentences_odd_rows(spark):
    out = sentence_spans.remove_repeats(odd_frame(spark)).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in odd_rows())
    assert sentence_spans.remove_repeats(empty_frame(spark)).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    known = texts()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "exact dedup", "near dedup", "personal data", "best-fit packing"]
    results = []
    for _, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, FOLDER).cache()
        results.append(docs)
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert docs.columns == before.columns
    base = {i for i, t in known.items() if measured(t)[0] >= 50 and 100 * measured(t)[4] <= 50 * measured(t)[0]}
    good = {r["doc_id"] for r in results[0].collect()}
    assert good <= base and len(good) >= 0.95 * len(base)
    first = {}
    for i in sorted(good):
        first.setdefault(plain(known[i]), i)
    assert {r["doc_id"] for r in results[1].collect()} == set(first.values())
    left = sorted((i, known[i]) for i in first.values())
    assert {r["doc_id"] for r in results[2].collect()} == set(classes_by_pairs(left))
    for r in results[3].collect():
        assert not base_spans(r["text"]) or r["text"] != known[r["doc_id"]]
        if not base_spans(known[r["doc_id"]]):
            assert r["text"] == known[r["doc_id"]]
    assert {r["doc_id"] for r in results[4].collect()} == {r["doc_id"] for r in results[2].collect()}


def test_pipeline_query(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"](spark, FOLDER).count() > 0
