"""Prediction by partial matching against counts in dictionaries."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
from helpers import FOLDER, empty_frame, odd_frame, odd_rows, texts
from pyspark.sql import functions as F

from corpuslab.llm import partial_matching as ppm
from corpuslab.llm.queries import QUERIES

START, END = b"\xff", b"\xfe"


def raw(text):
    return (text or "").encode().lower()


class Trie:
    """The same model by hand: a counter of next bytes for every context."""

    def __init__(self, known, order):
        self.order, self.next = order, defaultdict(Counter)
        for text in known:
            padded = START * order + raw(text) + END
            for i in range(order, len(padded)):
                for j in range(order + 1):
                    self.next[padded[i - j : i]][padded[i]] += 1

    def byte(self, context, symbol):
        value, out = 0.0, set()
        for j in range(self.order, -1, -1):
            seen = self.next.get(context[len(context) - j :])
            if seen is None:
                continue
            left = {s: n for s, n in seen.items() if s not in out}
            mass = sum(left.values()) + len(left)
            if symbol in left:
                return value + math.log10(left[symbol] / mass)
            if mass:
                value += math.log10(len(left) / mass)
            out |= set(seen)
        return value - math.log10(255 - len(out))

    def score(self, text):
        padded = START * self.order + raw(text) + END
        return math.fsum(self.byte(padded[i - self.order : i], padded[i]) for i in range(self.order, len(padded)))


def base_scores(known):
    counts = Counter()
    for text in known:
        counts.update(raw(text).split())
        counts[None] += 1
    total = sum(counts.values())
    mass = math.log10(total + 0.5 * (len(counts) + 1))

    def base(text):
        words = [*raw(text).split(), None]
        return total, len(words), sum(counts[w] > 0 for w in words), sum(math.log10(counts.get(w, 0) + 0.5) - mass for w in words)

    return base


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def check(rows, known, order):
    """``rows`` of the operator against (doc_id, text, held_out) in any order."""
    training = [t for _, t, h in known if not h]
    trie, base = Trie(training, order), base_scores(training)
    key = lambda r: (str(r[0]), r[1], r[2], round(r[5], 3), round(r[6], 3))
    expected = []
    for doc_id, text, h in known:
        total, n, seen, score = base(text)
        expected.append((doc_id, h, n, seen, total, score, trie.score(text)))
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in rows), key=key)
    assert len(got) == len(expected)
    for a, b in zip(got, sorted(expected, key=key)):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_score_query(spark):
    rows = QUERIES["op11_partial_matching"](spark, FOLDER).collect()
    check(rows, [(i, t, held(i)) for i, t in texts().items()], ppm.ORDER)


@pytest.mark.parametrize("order", [3, 5])
def test_scores_of_small_blocks(spark, order):
    """Many blocks, other orders, and the odd rows."""
    rows = ppm.score_texts(odd_frame(spark), ppm.held_out_ids(), order=order, block_bytes=300).collect()
    check(rows, [(r[0], r[1], held(r[0])) for r in odd_rows()], order)


def test_scores_without_training(spark):
    docs = odd_frame(spark)
    rows = ppm.score_texts(docs, F.lit(True)).collect()
    check(rows, [(r[0], r[1], True) for r in odd_rows()], ppm.ORDER)
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in rows)
    assert ppm.score_texts(empty_frame(spark), ppm.held_out_ids()).count() == 0
    with pytest.raises(ValueError):
        ppm.score_texts(docs, F.lit(True), order=2)


def test_probabilities_add_up(spark):
    """After any context, known or not, the probabilities of all symbols add up to one."""
    trie = Trie(["abracadabra", "abrabra", "é"], 3)
    for context in (b"abr", b"zab", b"zzz", START * 3, b"\xff\xc3\xa9"):
        assert math.fsum(10 ** trie.byte(context, s) for s in range(255)) == pytest.approx(1)


def test_stored_model(spark):
    """A model of some documents scores others as if they had been held out beside them."""
    docs = spark.createDataFrame([(i, f"the cat {i} sat on the mat") for i in range(20)], "doc_id long, text string")
    more = spark.createDataFrame([(100, "the dog sat"), (101, "zzz")], "doc_id long, text string")
    model = ppm.fit_trie(ppm.gather_blocks(docs, F.lit(False)))
    alone = {r["doc_id"]: r["score"] for r in ppm.score_texts(more, F.lit(True), trie=model).collect()}
    beside = ppm.score_texts(docs.unionByName(more), F.col("doc_id") >= 100).filter("doc_id >= 100")
    assert alone == pytest.approx({r["doc_id"]: r["score"] for r in beside.collect()})


def test_held_out_texts_are_predicted_better_than_by_short_contexts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    sums = [
        ppm.score_texts(docs, ppm.held_out_ids(), order=k).filter("held_out").agg(F.sum("score")).first()[0] for k in (3, 4)
    ]
    assert sums[0] < sums[1] < 0
