"""Repeated sentences against every run of sentences."""

import random

from corpuslab.llm import sentence_spans


def long_enough(words):
    return any(len(words) >= s and sum(words) >= w for s, w in ((1, 40), (2, 24), (3, 12)))


def kept_by_hand(rows):
    """The sentences that lie under no run that a smaller id, or the same text before, holds."""
    runs, first = [], {}
    for i, parts in sorted(rows.items()):
        sizes = [len(p.split()) for p in parts]
        for a in range(len(parts)):
            for b in range(a, len(parts)):
                if long_enough(sizes[a : b + 1]):
                    key = tuple(parts[a : b + 1])
                    runs.append((i, a, b, key))
                    first.setdefault(key, (i, a))
    gone = {(i, k) for i, a, b, key in runs if first[key] != (i, a) for k in range(a, b + 1)}
    return {i: [p for k, p in enumerate(parts) if (i, k) not in gone] for i, parts in rows.items()}


def check_runs(spark, rows):
    docs = spark.createDataFrame([(i, " ".join(parts)) for i, parts in rows.items()], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in sentence_spans.remove_repeats(docs).collect()}
    kept = kept_by_hand(rows)
    assert {i: t.split() for i, t in out.items()} == {i: " ".join(k).split() for i, k in kept.items()}
    return kept


def test_every_repeated_run_is_removed(spark):
    pick = random.Random(7)
    pool = [" ".join(f"w{i}x{k}" for k in range(n)) + "." for i, n in enumerate([1, 3, 5, 8, 11, 13, 20, 26, 39, 41] * 3)]
    rows = {}
    for i in range(60):
        rows[i] = [pick.choice(pool) for _ in range(pick.randrange(1, 12))]
        source = rows[pick.randrange(i + 1)]
        a = pick.randrange(len(source))
        rows[i] = rows[i] + source[a : a + pick.randrange(1, 6)] + [pick.choice(pool)]
    check_runs(spark, rows)


def test_the_end_of_a_passage_is_removed(spark):
    sentence = lambda name, n: " ".join(f"{name}{k}" for k in range(n)) + "."
    for sizes in ((41, 39), (12, 12, 5)):
        passage = [sentence(f"p{n}q{k}x", n) for k, n in enumerate(sizes)]
        rows = {i: [sentence(f"a{i}x", 9), *passage, sentence(f"b{i}x", 9)] for i in range(3)}
        kept = check_runs(spark, rows)
        assert kept[0] == rows[0] and all(kept[i] == [rows[i][0], rows[i][-1]] for i in (1, 2))


def test_rows_without_an_id_lose_what_another_row_has(spark):
    """Rows without an id, and different texts of one id, are told apart by their order."""
    passage = " ".join(f"Sentence number {i} of a passage that many rows hold in common." for i in range(6))
    rows = [(i, f"Start {k} of a text. {passage}") for k, i in enumerate([None, None, 5, 5, None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = [(r["doc_id"], r["n_removed"], r["text"]) for r in sentence_spans.remove_repeats(docs).collect()]
    kept = [o for o in out if o[1] == 0]
    assert kept == [(5, 0, rows[2][1])]
    assert sorted(o[2].strip() for o in out if o[1]) == [f"Start {k} of a text." for k in (0, 1, 3, 4)]
