"""Verdicts on rows with missing and repeated doc_ids."""

from collections import Counter

from helpers import SCHEMA, empty_frame

from corpuslab.llm import host_rules


def test_rows_with_one_id_are_kept_or_dropped_on_their_own(spark):
    good = lambda name: " ".join(f"{name}{k}" for k in range(60))
    symbols = good("sym") + " #" * 20
    rows = [
        (None, good("a"), "en", "x", 1),
        (None, good("b"), "en", None, 2),
        (None, "too short", "en", "x", 3),
        (None, None, "en", "x", 4),
        (1, good("c"), "en", "x", 5),
        (1, "too short", "en", "x", 6),
        (1, good("c"), "en", "x", 7),
        (2, symbols, "en", "x", 8),
        (2, symbols, "en", "bad", 9),
    ]
    rows += [(100 + i, f"{symbols} {i}", "en", "bad", 100 + i) for i in range(400)]
    rows += [(1000 + i, good(f"d{i}x"), "en", "x", 1000 + i) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = host_rules.keep_good(docs)
    assert out.columns == docs.columns
    kept = {r["n_chars"] for r in out.collect()}
    assert kept == {1, 2, 5, 7, 8} | {1000 + i for i in range(400)}
    judged = Counter(r["doc_id"] for r in host_rules.judge(docs).filter("kept").collect())
    assert Counter(r["doc_id"] for r in out.collect()) == judged
    assert host_rules.keep_good(empty_frame(spark)).count() == 0


def test_one_failing_document_does_not_reject_its_host(spark):
    """A thousand hosts of one document: the prior outweighs each."""
    good, symbols = (" ".join(f"{p}{k}" for k in range(60)) for p in ("w", "v"))
    rows = [(i, symbols + " #" * 20 if i % 10 == 0 else good, "en", f"host{i}", 1) for i in range(1000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    failures = host_rules.rule_failures(host_rules.measures(docs)).cache()
    verdicts = host_rules.host_verdicts(failures).collect()
    assert len(verdicts) == 1000 and not any(r["rejected"] for r in verdicts)
    assert sum(r["n_failed"] for r in verdicts) == 100
    assert host_rules.keep_good(docs).count() == 1000


def test_prior_of_known_hosts(spark):
    """Rates drawn from a beta distribution give back its mean and strength."""
    import numpy as np

    draw = np.random.default_rng(3)
    sizes = draw.integers(5, 200, 3000)
    failed = draw.binomial(sizes, draw.beta(4, 16, 3000))
    hosts = spark.createDataFrame(list(zip(sizes.tolist(), failed.tolist())), "n_docs long, n_failed long")
    mean, strength = host_rules.fitted_prior(hosts)
    assert abs(mean - 0.2) < 0.01 and abs(strength - 20) < 2
    assert host_rules.fitted_prior(hosts.limit(0)) == (0.0, host_rules.OPEN_STRENGTH)
    assert host_rules.fitted_prior(hosts.withColumn("n_failed", hosts["n_docs"] * 0))[1] == host_rules.OPEN_STRENGTH


def test_columns_of_any_name_pass_the_stages(spark):
    """Columns named like those that the stages work with come back with their content."""
    import corpus_pipeline

    names = ["_key", "_row", "row", "text_key", "_id", "_edits", "_reach", "_text", "host", "failed", "n.docs"]
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(i, text(i // 2) + " mail a@b.org", "en", "a", 9, *[f"{n}{i}" for n in names]) for i in range(8)]
    docs = spark.createDataFrame(rows, SCHEMA + "".join(f", `{n}` string" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() > 0
        for r in out.collect():
            assert r[5:] == tuple(f"{n}{r['doc_id']}" for n in names)
