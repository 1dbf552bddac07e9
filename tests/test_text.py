import re
from collections import Counter

from conftest import rows_of
from pyspark.sql import functions as F

from corpuslab.fixed_values import CUE_NGRAMS
from corpuslab.functions.text import OUTER_HYPHENS
from corpuslab.operators import bow, joins, ngrams

TEXTS = [
    (1, "This is a recurring pro-Kremlin narrative. See https://a.org/x. The EU is fine!"),
    (2, "See similar cases: http://b.org/1 and http://b.org/2\nRead on at https://c.org/3."),
    (3, ""),
    (4, "the the the cat"),
]


def test_sentences(frame):
    found = rows_of(ngrams.sentences(frame(TEXTS, "id int, t string"), "id", "t"))
    assert found[0] == (1, 0, "this is a recurring pro-kremlin narrative")
    assert (1, 2, "the eu is fine") in found and not [r for r in found if r[0] == 3]


def test_ngram_counts_count_sentences_not_occurrences(frame):
    df = frame([(1, "a b c a b c. a b c d\nx y"), (2, "a b c")], "id int, t string")
    found = rows_of(ngrams.ngram_counts(df, "id", "t", min_sentences=2))
    assert found == [("a b c", 3, 3)]
    everything = rows_of(ngrams.ngram_counts(df, "id", "t", min_sentences=1), "ngram", "sentences")
    expected = Counter()
    for sentence in ("a b c a b c", "a b c d", "x y", "a b c"):
        words = sentence.split()
        expected.update({" ".join(words[i : i + n]) for n in (3, 4) for i in range(len(words) - n + 1)})
    assert dict(everything) == dict(expected)


def test_urls_next_to_a_cue_are_removed(frame):
    found = rows_of(ngrams.cue_free_urls(frame(TEXTS, "id int, t string"), "id", "t", CUE_NGRAMS))
    assert found == [(1, 1, "https://a.org/x"), (2, 1, "https://c.org/3")]


def test_bow_counts(frame):
    found = rows_of(bow.bow_counts(frame(TEXTS[3:], "id int, t string"), "id", "t"))
    assert found == [(4, "cat", 1), (4, "the", 3)]


def test_unseen_terms_are_dropped(frame):
    train = frame([(1, "aa bb")], "id int, t string")
    other = frame([(2, "bb bb cc"), (3, "dd")], "id int, t string")
    assert rows_of(bow.counts_in_vocabulary(train, other, "id", "t")) == [(2, "bb", 2)]


def test_vocabulary_and_encoding_equal_brute_force(frame):
    data = [(i, " ".join(f"w{(i * j) % 23}" for j in range(i % 17))) for i in range(60)] + [(99, "")]
    df = frame(data, "id int, t string")
    counts = Counter(w for _, t in data for w in re.findall(r"\w{2,}", t))
    order = sorted(counts, key=lambda w: (-counts[w], w))
    numbers = {w: i + 2 for i, w in enumerate(order)}
    vocabulary = bow.fit_vocabulary(df, "t")
    assert rows_of(vocabulary) == sorted((w, counts[w], numbers[w]) for w in order)
    found = bow.encode_fixed(df, "id", "t", vocabulary, length=8).collect()
    assert len(found) == len(data)
    texts = dict(data)
    for row in found:
        ids = [numbers[w] for w in re.findall(r"\w{2,}", texts[row["id"]])][:8]
        assert row["input_ids"] == ids + [0] * (8 - len(ids))
        assert row["attention_mask"] == [1] * len(ids) + [0] * (8 - len(ids))


def test_small_vocabulary_gives_unknown_tokens(frame):
    df = frame([(1, "aa aa bb")], "id int, t string")
    encoded = bow.encode_fixed(df, "id", "t", bow.fit_vocabulary(df, "t", size=1), length=4).first()
    assert encoded["input_ids"] == [2, 2, 1, 0]


def test_hot_keys_are_joined_whole(spark, frame):
    """One key covers a third of the rows; another has no match; null keys have none either."""
    left = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), "id")).alias("k")
    )
    right = frame([("hot", 1), ("k1", 2), ("k4", 3), ("never", 4)], "k string, v int")
    found = joins.hot_key_lookup(left, right, "k")
    assert found.count() == 2000
    assert found.filter("k = 'hot' and v = 1").count() == 1000
    assert found.filter("v is not null").count() == 1002
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan


def test_weighted_lookup_broadcasts_a_bounded_number_of_rows(spark):
    left = spark.range(10_000).select((F.col("id") % 5000).alias("k"))
    right = left.groupBy("k").agg(F.count("*").alias("w"), F.max("k").alias("v"))
    assert joins.weighted_lookup(left, right, "k", "w", slices=100).count() == 10_000
    assert joins.weighted_lookup(left, right, "k", "w", slices=10_000).count() == 10_000


def test_topic_matches_keep_repeats(frame):
    df = frame([(1, "Red, small, SMALL"), (2, "none"), (3, None)], "id int, k string")
    topics = {"colour": ["red"], "size": ["small"], "both": ["red"]}
    found = rows_of(joins.topic_matches(df, "id", "k", topics))
    assert found == [(1, "red", "both"), (1, "red", "colour"), (1, "small", "size"), (1, "small", "size")]


def test_encoding_shuffles_a_number_per_token(frame):
    """The lists of a text are gathered from numbers that keep the order of places."""
    df = frame([(1, " ".join(f"w{i % 37}" for i in range(600))), (2, ""), (3, "w0 unseen w1")], "id long, t string")
    vocabulary = frame([(f"w{i}", 20, 2**33 + i) for i in range(37)], "term string, n long, token_id long")
    encoded = bow.encode_fixed(df, "id", "t", vocabulary)
    plan = encoded._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(token" in plan and "collect_list(if" not in plan and "collect_list(CASE" not in plan
    found = {r["id"]: r["input_ids"] for r in encoded.collect()}
    assert found[1] == [2**33 + i % 37 for i in range(512)]
    assert found[2] == [bow.PAD] * 512
    assert found[3][:4] == [2**33, bow.UNKNOWN, 2**33 + 1, bow.PAD]


def test_outer_hyphens_are_tried_at_hyphens_only(frame):
    """The same words as by the pattern without its look at the next character."""
    texts = ["-a b- --c-- d-e f--g - -- --- h-\u00a0-i", "", "-", "a\x1c-b-\x1dc", "\u2003-x-\u2003y--\tz-", "no hyphen"]
    plain = r"(?U)(?<![^\s\x1c-\x1f])-+|-+(?![^\s\x1c-\x1f])"
    df = frame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    found = df.select(F.regexp_replace("t", OUTER_HYPHENS, "").alias("a"), F.regexp_replace("t", plain, "").alias("b"))
    assert OUTER_HYPHENS.startswith("(?U)(?=-)") and all(r["a"] == r["b"] for r in found.collect())
