"""ANSI SQL for the catalogue, used to check its results in another engine."""

from __future__ import annotations

ARTICLES = """
SELECT d.doc_id AS article_id, d.text AS article_text,
  CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE split_part(d.text, chr(10), 1) END AS article_title,
  d.lang AS article_language, d.source AS article_publisher,
  CASE WHEN l.toxic = 1 THEN 'disinformation' WHEN l.toxic = 0 THEN 'support' END AS class,
  CAST(floor(d.doc_id / 3) AS BIGINT) AS debunk_id,
  CAST(o.o_orderdate AS DATE) AS debunk_date,
  concat(lpad(CAST(day(o.o_orderdate) AS STRING), 2, '0'), '-',
    lpad(CAST(month(o.o_orderdate) AS STRING), 2, '0'), '-',
    CAST(year(o.o_orderdate) AS STRING)) AS published_date,
  CASE WHEN d.doc_id % 7 <> 0
    THEN concat_ws(', ', replace(p.p_name, ' ', ', '), p.p_type) END AS keywords
FROM documents d JOIN orders o ON o.o_orderkey = d.doc_id JOIN part p ON p.p_partkey = d.doc_id
LEFT JOIN labels l ON l.doc_id = d.doc_id
"""
LABELLED = """
SELECT *, CASE WHEN class = 'disinformation' THEN 1 ELSE 0 END AS label
FROM articles WHERE class IS NOT NULL
"""
CASES = """
SELECT o_orderkey AS article_id, o_custkey AS debunk_id, o_orderstatus AS class,
  o_orderpriority AS article_language, CAST(o_orderdate AS DATE) AS debunk_date
FROM orders
"""
PREDICTIONS = """
SELECT l.doc_id, d.lang AS language, l.toxic AS label, 1 - l.quality AS pred,
  concat('set', CAST(l.doc_id % 3 AS STRING)) AS dataset, CAST(l.doc_id % 5 AS INT) AS fold
FROM labels l JOIN documents d ON d.doc_id = l.doc_id
"""
CACHE_LOG = """
SELECT page_id AS article_id, url AS article_url, 1 AS attempt, html AS article_text FROM pages
UNION ALL
SELECT page_id, url, 2, concat('again ', html) FROM pages WHERE page_id % 3 = 0
"""
VIEWS = {
    "articles": ARTICLES,
    "labelled": LABELLED,
    "cases": CASES,
    "predictions": PREDICTIONS,
    "cache_log": CACHE_LOG,
}
NEEDS = {"labelled": ["articles"]}


def sql(body: str, *views: str, **more: str) -> str:
    """``body`` after a WITH clause of the named views and of further named queries."""
    names: list[str] = []
    for view in views:
        names += [v for v in [*NEEDS.get(view, []), view] if v not in names]
    parts = [f"{n} AS ({VIEWS[n].strip()})" for n in names]
    parts += [f"{n} AS ({q.strip()})" for n, q in more.items()]
    first = "WITH RECURSIVE " if "svm_steps" in more else "WITH "
    head = first + ",\n".join(parts) + "\n" if parts else ""
    return head + body.strip()


def quarter(date: str) -> str:
    return f"concat(CAST(year({date}) AS STRING), '-Q', CAST(quarter({date}) AS STRING))"


# Words of the bag-of-words models, of sentences and of a text split at blanks.
WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]{{2,}}')"
SPACE_TOKENS = r"list_filter(regexp_split_to_array({0}, '[\s\p{{Z}}\x1c-\x1f\x85]+'), lambda x: x <> '')"
SENTENCE_WORDS = (
    "list_filter(list_transform(regexp_split_to_array("
    r"regexp_replace(lower({0}), '[^\p{{L}}\p{{M}}\p{{N}}\p{{Z}}\s-]+', '', 'g'), '[\s\p{{Z}}]+'), "
    "lambda w: regexp_replace(w, '^-+|-+$', '', 'g')), lambda w: w <> '')"
)
KEYWORDS = "list_transform(string_split({0}, ','), lambda x: trim(x))"


def train_test(source: str, row_id: str, strata: list[str], seed: int = 42) -> dict[str, str]:
    """CTEs that end in ``split_rows``: exact split of ``source`` by largest remainder."""
    stratum = (
        "concat_ws(chr(31), "
        + ", ".join(f"coalesce(CAST({s} AS VARCHAR), '')" for s in strata)
        + ")"
        if strata
        else "''"
    )
    return {
        "keyed": f"SELECT *, {stratum} AS stratum_, md5(concat('{seed}|', CAST({row_id} AS VARCHAR))) AS key_ FROM {source}",
        "sizes": "SELECT stratum_, count(*) AS c FROM keyed GROUP BY 1",
        "whole": "SELECT sum(c) AS n, sum(c) - CAST(ceil(sum(c) * CAST(0.1 AS DOUBLE)) AS BIGINT) AS n_train FROM sizes",
        "quota": "SELECT stratum_, c, n_train, (c * n_train) // n AS base, (c * n_train) % n AS rest FROM sizes, whole",
        "filled": """SELECT stratum_, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, stratum_)
            <= n_train - sum(base) OVER () THEN 1 ELSE 0 END AS train FROM quota""",
        "split_rows": """SELECT k.* EXCLUDE (stratum_, key_), CASE WHEN row_number() OVER (
              PARTITION BY k.stratum_ ORDER BY key_) <= f.train THEN 'train' ELSE 'test' END AS split
            FROM keyed k JOIN filled f ON f.stratum_ = k.stratum_""",
    }


def folds(source: str, row_id: str, strata: list[str], k: int = 10, seed: int = 42) -> dict[str, str]:
    """CTEs that end in ``fold_rows``: balanced folds of ``source`` as ranges of the md5 order."""
    stratum = "concat_ws(chr(31), " + ", ".join(f"coalesce(CAST({s} AS VARCHAR), '')" for s in strata) + ")"
    return {
        "f_keyed": f"SELECT *, {stratum} AS stratum_, md5(concat('{seed}|', CAST({row_id} AS VARCHAR))) AS key_ FROM {source}",
        "f_ranked": "SELECT *, row_number() OVER (PARTITION BY stratum_ ORDER BY key_) AS rank_ FROM f_keyed",
        "f_sizes": "SELECT stratum_, count(*) AS c FROM f_keyed GROUP BY 1",
        "f_shift": """SELECT stratum_, c, coalesce(sum(c) OVER (ORDER BY stratum_
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM f_sizes""",
        # The fold of position p would be (shift + p) mod k when dealt in turn; only the number of
        # rows per fold is taken from that.
        "f_dealt": f"""SELECT s.stratum_, CAST((s.shift + g.p) % {k} AS INT) AS fold, count(*) AS size
            FROM f_shift s, LATERAL (SELECT unnest(generate_series(0, s.c - 1)) AS p) g GROUP BY 1, 2""",
        "f_ends": """SELECT stratum_, fold, size, sum(size) OVER (PARTITION BY stratum_ ORDER BY fold) AS last_
            FROM f_dealt""",
        "fold_rows": """SELECT r.* EXCLUDE (stratum_, key_, rank_), e.fold FROM f_ranked r
            JOIN f_ends e ON e.stratum_ = r.stratum_ AND r.rank_ <= e.last_ AND r.rank_ > e.last_ - e.size""",
    }


def naive_bayes(train: str, test: str, alphas: list[float]) -> dict[str, str]:
    """CTEs that end in ``nb``; ``train`` is (model, id, label, text), ``test`` has a language too."""
    values = ", ".join(f"(CAST({a} AS DOUBLE))" for a in alphas)
    return {
        "nb_train": train,
        "nb_test": test,
        "nb_words": f"SELECT model, label, unnest({WORDS.format('text')}) AS term FROM nb_train",
        "nb_terms": """SELECT model, term, sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS n0,
            sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS n1 FROM nb_words GROUP BY 1, 2""",
        "nb_mass": "SELECT model, sum(n0) AS m0, sum(n1) AS m1, count(*) AS v FROM nb_terms GROUP BY 1",
        "nb_prior": """SELECT model, sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS d0,
            sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS d1, count(*) AS d FROM nb_train GROUP BY 1""",
        "nb_alpha": f"SELECT * FROM (VALUES {values}) AS t(alpha)",
        "nb_tf": f"""SELECT model, id, term, count(*) AS tf FROM
            (SELECT model, id, unnest({WORDS.format('text')}) AS term FROM nb_test) GROUP BY 1, 2, 3""",
        "nb_sums": """SELECT f.model, f.id, a.alpha, sum(f.tf) AS known,
              sum(f.tf * ln(t.n0 + a.alpha)) AS s0, sum(f.tf * ln(t.n1 + a.alpha)) AS s1
            FROM nb_tf f JOIN nb_terms t ON t.model = f.model AND t.term = f.term, nb_alpha a
            GROUP BY 1, 2, 3""",
        "nb_scores": """SELECT x.model, x.id, x.label, x.language, a.alpha,
              CASE WHEN p.d0 > 0 THEN ln(p.d0 / p.d) + coalesce(s.s0, 0)
                - coalesce(s.known, 0) * ln(m.m0 + a.alpha * m.v) END AS score_0,
              CASE WHEN p.d1 > 0 THEN ln(p.d1 / p.d) + coalesce(s.s1, 0)
                - coalesce(s.known, 0) * ln(m.m1 + a.alpha * m.v) END AS score_1
            FROM nb_test x JOIN nb_mass m ON m.model = x.model JOIN nb_prior p ON p.model = x.model
            CROSS JOIN nb_alpha a
            LEFT JOIN nb_sums s ON s.model = x.model AND s.id = x.id AND s.alpha = a.alpha""",
        "nb": """SELECT *, CASE WHEN score_1 > coalesce(score_0, CAST('-inf' AS DOUBLE))
            THEN 1 ELSE 0 END AS pred FROM nb_scores""",
    }


def linear_svm(train: str, test: str, costs: list[float]) -> dict[str, str]:
    """CTEs that end in ``svm``; the parts are as for ``naive_bayes``.

    All training documents are one block. ``svm_steps`` has a row per step: the lists of dual
    variables and margins, changed at the place that gains most.
    """
    values = ", ".join(f"(CAST({c} AS DOUBLE))" for c in costs)

    def words(keys: str, source: str) -> str:
        return f"""SELECT {keys}, term, count(*) AS tf FROM
            (SELECT {keys}, unnest({WORDS.format('text')}) AS term FROM {source}) GROUP BY ALL"""

    def zipped(lists: str, body: str) -> str:
        return f"list_transform(list_zip({lists}), lambda p: {body})"

    return {
        "svm_train": train,
        "svm_test": test,
        "svm_docs": """SELECT model, id, CASE WHEN label = 1 THEN CAST(1 AS DOUBLE) ELSE -1 END AS y,
            row_number() OVER (PARTITION BY model ORDER BY id) AS i FROM svm_train""",
        "svm_texts": "SELECT DISTINCT id, text FROM svm_train",
        "svm_tf": words("id", "svm_texts"),
        "svm_pairs": """SELECT a.id AS a, b.id AS b, sum(a.tf * b.tf) AS k FROM svm_tf a JOIN svm_tf b ON b.term = a.term
            GROUP BY 1, 2""",
        "svm_rows": """SELECT x.model, x.i, list(CAST(coalesce(p.k, 0) + 1 AS DOUBLE) ORDER BY z.i) AS row_
            FROM svm_docs x JOIN svm_docs z ON z.model = x.model LEFT JOIN svm_pairs p ON p.a = x.id AND p.b = z.id
            GROUP BY 1, 2""",
        "svm_fixed": f"""SELECT d.model, c.cost, count(*) AS n, list(d.y ORDER BY d.i) AS y, list(r.row_[d.i] ORDER BY d.i) AS own
            FROM svm_docs d JOIN svm_rows r ON r.model = d.model AND r.i = d.i, (VALUES {values}) AS c(cost) GROUP BY 1, 2""",
        "svm_steps": f"""SELECT model, cost, 0 AS step, list_transform(y, lambda x: CAST(0 AS DOUBLE)) AS dual,
              list_transform(y, lambda x: CAST(0 AS DOUBLE)) AS f FROM svm_fixed
            UNION ALL
            SELECT g.model, g.cost, g.step + 1,
              list_transform(g.dual, lambda v, k: CASE WHEN k = g.j THEN v + g.change[g.j] ELSE v END),
              {zipped('g.f, r.row_', 'p[1] + p[2] * (g.change[g.j] * g.y[g.j])')}
            FROM (SELECT *, list_position(gain, list_max(gain)) AS j FROM
              (SELECT *, {zipped('change, gap_left, own', 'p[1] * (p[2] - p[1] * p[3] / 2)')} AS gain FROM
              (SELECT *, {zipped('dual, gap_left, own', 'least(greatest(p[1] + p[2] / p[3], 0), cost) - p[1]')} AS change FROM
              (SELECT s.*, c.n, c.y, c.own, {zipped('c.y, s.f', '1 - p[1] * p[2]')} AS gap_left
               FROM svm_steps s JOIN svm_fixed c ON c.model = s.model AND c.cost = s.cost)))
              WHERE step % n <> 0 OR list_sum({zipped('dual, gap_left', 'cost * greatest(0, p[2]) - p[1] * p[2]')})
                > 0.001 * list_sum(dual) / 2) g
            JOIN svm_rows r ON r.model = g.model AND r.i = g.j WHERE list_max(g.gain) > 0""",
        "svm_ends": "SELECT model, cost, arg_max(dual, step) AS dual FROM svm_steps GROUP BY 1, 2",
        "svm_duals": """SELECT e.model, e.cost, d.id, d.y * e.dual[d.i] AS a FROM svm_ends e JOIN svm_docs d ON d.model = e.model""",
        "svm_weights": """SELECT d.model, d.cost, t.term, sum(d.a * t.tf) AS w FROM svm_duals d JOIN svm_tf t ON t.id = d.id
            WHERE d.a <> 0 GROUP BY 1, 2, 3""",
        "svm_offset": "SELECT model, cost, sum(a) AS b FROM svm_duals GROUP BY 1, 2",
        "svm_test_tf": words("model, id", "svm_test"),
        "svm_sums": """SELECT t.model, t.id, w.cost, sum(t.tf * w.w) AS s FROM svm_test_tf t
            JOIN svm_weights w ON w.model = t.model AND w.term = t.term GROUP BY 1, 2, 3""",
        "svm": """SELECT *, CASE WHEN margin > 0 THEN 1 ELSE 0 END AS pred FROM
            (SELECT x.model, x.id, x.label, x.language, o.cost, o.b + coalesce(s.s, 0) AS margin FROM svm_test x
             JOIN svm_offset o ON o.model = x.model
             LEFT JOIN svm_sums s ON s.model = x.model AND s.id = x.id AND s.cost = o.cost)""",
    }


def f1(source: str, keys: list[str], name: str = "f1") -> dict[str, str]:
    """One CTE with macro-F1 and the number of rows per key combination of ``source``."""
    comma = "".join(f"{k}, " for k in keys)
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    body = f"""SELECT {comma}avg(CAST(2 * tp AS DOUBLE) / (support + predicted)) AS f1,
          CAST(sum(support) AS BIGINT) AS n FROM (
        SELECT {comma}class, sum(tp) AS tp, sum(support) AS support, sum(predicted) AS predicted FROM (
          SELECT {comma}label AS class, CASE WHEN label = pred THEN 1 ELSE 0 END AS tp, 1 AS support, 0 AS predicted FROM {source}
          UNION ALL SELECT {comma}pred, 0, 0, 1 FROM {source}) GROUP BY {comma}class) {group}"""
    return {name: body}


def report(source: str, keys: list[str]) -> dict[str, str]:
    """CTE ``report``: mean over languages, weighted mean and overall macro-F1 per key."""
    comma = ", ".join(keys)
    using = f"USING ({comma})"
    return {
        **f1(source, [*keys, "language"], "by_language"),
        **f1(source, keys, "overall"),
        "averages": f"""SELECT {comma}, avg(f1) AS f1_avg, sum(f1 * n) / sum(n) AS f1_weighted
            FROM by_language GROUP BY {comma}""",
        "report": f"""SELECT {comma}, round(f1_avg, 6) AS f1_avg, round(f1_weighted, 6) AS f1_weighted,
            round(f1, 6) AS f1_overall FROM averages JOIN overall {using}""",
    }


SPLIT_SOURCE = """SELECT article_id, article_text AS text, label, article_language AS language,
    keywords, published_date FROM labelled"""
SPLIT = {"source": SPLIT_SOURCE, **train_test("source", "article_id", ["label", "language"])}
ALL_ALPHAS = [0.01, 0.1, 1.0, 10.0]


def one_model(part: str) -> str:
    return f"SELECT 'split' AS model, article_id AS id, label, language, text FROM split_rows WHERE split = '{part}'"


SEARCH = {
    **SPLIT,
    **naive_bayes(one_model("train"), one_model("test"), ALL_ALPHAS),
    **f1("nb", ["alpha", "language"], "by_language"),
    "searched": "SELECT alpha, avg(f1) AS score FROM by_language GROUP BY 1",
    "chosen": "SELECT alpha FROM searched WHERE score > 0 ORDER BY score DESC, alpha LIMIT 1",
}
SVM_SEARCH = {
    **SPLIT,
    **linear_svm(one_model("train"), one_model("test"), [0.001, 0.1, 1.0, 5.0, 10.0]),
    **f1("svm", ["cost", "language"], "by_language"),
    "searched": "SELECT cost, avg(f1) AS score FROM by_language GROUP BY 1",
    "chosen": "SELECT cost FROM searched WHERE score > 0 ORDER BY score DESC, cost LIMIT 1",
}
FOLD_ROWS = {
    **SPLIT,
    "train_rows": "SELECT * EXCLUDE (split) FROM split_rows WHERE split = 'train'",
    **folds("train_rows", "article_id", ["language"]),
    "models": "SELECT CAST(unnest(generate_series(0, 9)) AS INT) AS model",
}
FOLD_PARTS = (
    "SELECT m.model, article_id AS id, label, text FROM fold_rows r JOIN models m ON r.fold <> m.model",
    "SELECT fold AS model, article_id AS id, label, language, text FROM fold_rows",
)
CELLS = """SELECT model, language, f1 FROM by_language
    UNION ALL SELECT model, 'Average', avg(f1) FROM by_language GROUP BY model"""
KFOLD = {
    **FOLD_ROWS, **naive_bayes(*FOLD_PARTS, [0.1]), **f1("nb", ["model", "language"], "by_language"), "cells": CELLS
}
SVM_KFOLD = {
    **FOLD_ROWS, **linear_svm(*FOLD_PARTS, [0.1]), **f1("svm", ["model", "language"], "by_language"), "cells": CELLS
}


def dataset_grid() -> dict[str, str]:
    ctes: dict[str, str] = {}
    for i in range(3):
        source = f"""SELECT article_id, article_text AS text, label, article_language AS language,
            concat('set', CAST(article_id % 3 AS STRING)) AS dataset FROM labelled WHERE article_id % 3 = {i}"""
        part = {"source": source, **train_test("source", "article_id", ["language", "label"])}
        nested = ",\n".join(f"{n} AS ({q})" for n, q in part.items())
        ctes[f"part{i}"] = f"WITH {nested} SELECT * FROM split_rows"
    ctes["parts"] = " UNION ALL ".join(f"SELECT * FROM part{i}" for i in range(3))
    ctes |= naive_bayes(
        "SELECT dataset AS model, article_id AS id, label, text FROM parts WHERE split = 'train'",
        """SELECT m.model, article_id AS id, label, language, text FROM parts
           CROSS JOIN (SELECT DISTINCT dataset AS model FROM parts) m WHERE split = 'test'""",
        [0.1],
    )
    ctes["pairs"] = """SELECT n.model AS train_dataset, concat('set', CAST(n.id % 3 AS STRING)) AS test_dataset,
        n.language, n.label, n.pred FROM nb n"""
    return ctes | report("pairs", ["train_dataset", "test_dataset"])


TOPICS = {
    "colour": ["red", "blue"],
    "heat": ["hot", "cold"],
    "age": ["new", "old"],
    "size": ["small", "large", "medium"],
}
TOPIC_VALUES = ", ".join(f"('{w}', '{t}')" for t, ws in TOPICS.items() for w in ws)
MATCHES = {
    "topic_words": f"SELECT * FROM (VALUES {TOPIC_VALUES}) AS t(keyword, topic)",
    "listed": f"SELECT article_id, unnest({KEYWORDS.format('lower(keywords)')}) AS keyword FROM articles WHERE keywords IS NOT NULL",
    "matches": "SELECT l.article_id, l.keyword, w.topic FROM listed l JOIN topic_words w ON w.keyword = l.keyword",
    "members": "SELECT DISTINCT article_id, topic FROM matches",
    "topics": "SELECT DISTINCT topic FROM topic_words",
    "held": """SELECT m.article_id, t.topic AS held_out,
        CASE WHEN max(CASE WHEN m.topic = t.topic THEN 1 ELSE 0 END) = 1 THEN 'test' ELSE 'train' END AS split
        FROM members m CROSS JOIN topics t GROUP BY 1, 2""",
}


def topic_report() -> str:
    with_topic = "SELECT * FROM source WHERE article_id IN (SELECT article_id FROM members)"
    source = SPLIT_SOURCE
    random = train_test("topic_rows", "article_id", [])
    names = {t: (", ".join(o for o in TOPICS if o != t), t) for t in TOPICS}
    names["all"] = (", ".join(TOPICS), ", ".join(TOPICS))
    described = ", ".join(f"('{m}', '{a}', '{b}')" for m, (a, b) in names.items())
    base = "article_id AS id, label, language, text"
    ctes = {
        **MATCHES,
        "source": source,
        "topic_rows": with_topic,
        **random,
        "arranged": f"""SELECT h.held_out AS model, r.article_id AS id, label, language, text, h.split
            FROM topic_rows r JOIN held h ON h.article_id = r.article_id
            UNION ALL SELECT 'all', {base}, split FROM split_rows""",
        **naive_bayes(
            "SELECT model, id, label, text FROM arranged WHERE split = 'train'",
            "SELECT model, id, label, language, text FROM arranged WHERE split = 'test'",
            [0.1],
        ),
        **report("nb", ["model"]),
        "described": f"SELECT * FROM (VALUES {described}) AS t(model, train_topics, test_topics)",
    }
    return sql(
        "SELECT train_topics, test_topics, f1_avg, f1_weighted, f1_overall FROM report JOIN described USING (model)",
        "labelled",
        **ctes,
    )


DAY = "strptime(published_date, '%d-%m-%Y')"
EVENTS = {"first": "1997-01-01", "second": "1999-01-01"}
EVENT_VALUES = ", ".join(f"('{e}', DATE '{d}')" for e, d in EVENTS.items())
DATED = {
    "events_": f"SELECT * FROM (VALUES {EVENT_VALUES}) AS t(event, cutoff)",
    "dated": f"""SELECT a.*, e.event, CASE WHEN {DAY} < e.cutoff THEN 'train' ELSE 'test' END AS split
        FROM labelled a CROSS JOIN events_ e""",
}
BALANCED = {
    "per_language": """SELECT article_language, CAST(sum(label) AS DOUBLE) / count(*) AS share, count(*) AS total
        FROM labelled GROUP BY 1""",
    "kept": "SELECT article_language FROM per_language WHERE share < 0.9 AND share > 1 - 0.9 AND total > 40",
}
CODE_VALUES = "(VALUES ('en', 'English'), ('fr', 'French'), ('es', 'Spanish')) AS c(code, name)"
SENTENCES = {
    "pieces": r"""SELECT article_id, unnest(regexp_split_to_array(article_text, '[.!?]+\s+|\n+')) AS raw,
        generate_subscripts(regexp_split_to_array(article_text, '[.!?]+\s+|\n+'), 1) - 1 AS pos FROM articles""",
    "sentences": f"SELECT article_id, pos, {SENTENCE_WORDS.format('raw')} AS words FROM pieces",
}


def ngram_list(words: str, n: int) -> str:
    parts = ", ' ', ".join(f"{words}[i + {k}]" if k else f"{words}[i]" for k in range(n))
    return f"list_transform(generate_series(1, len({words}) - {n - 1}), lambda i: concat({parts}))"


CUES = ["of the and", "the of the", "de la le", "the and of", "and the of the"]
CUE_LIST = "[" + ", ".join(f"'{c}'" for c in CUES) + "]"
F1_CELLS = {
    **f1("predictions", ["fold", "language"], "by_language"),
    "cells": """SELECT fold, language, f1 FROM by_language
        UNION ALL SELECT fold, 'Average', avg(f1) FROM by_language GROUP BY fold""",
}
OUTCOMES = {
    "responses": """SELECT page_id AS article_id, CASE WHEN page_id % 10 = 0 THEN 404 ELSE 200 END AS status,
        CASE WHEN page_id % 10 = 1 THEN 'fetch error' END AS error,
        CASE WHEN page_id % 10 IN (2, 3) THEN '' WHEN page_id % 10 <> 1 THEN html END AS text FROM pages""",
    "has_snapshot": "SELECT DISTINCT url FROM pages WHERE page_id % 10 IN (1, 2) AND url NOT LIKE '%7'",
    "copies": """SELECT page_id AS article_id, CASE WHEN page_id % 20 = 11 THEN 'fetch error' END AS error,
        CASE WHEN page_id % 20 = 2 THEN '' WHEN page_id % 20 <> 11 THEN html END AS text
        FROM pages WHERE page_id % 10 IN (1, 2)""",
    "decided": """SELECT p.page_id AS article_id, p.url AS article_url, CASE
          WHEN r.status <> 200 THEN 'http_skip'
          WHEN r.error IS NULL AND r.text <> '' THEN 'ok'
          WHEN s.url IS NULL THEN 'failed_no_archive'
          WHEN c.article_id IS NULL THEN 'exception'
          WHEN c.error IS NOT NULL THEN 'failed_error'
          WHEN c.text = '' THEN 'ok_empty' ELSE 'ok_archive' END AS outcome,
          r.text AS first_text, c.text AS copied_text
        FROM pages p JOIN responses r ON r.article_id = p.page_id
        LEFT JOIN has_snapshot s ON s.url = p.url LEFT JOIN copies c ON c.article_id = p.page_id""",
}

ORACLE: dict[str, str] = {
    "scan_csv_roundtrip": sql(
        """SELECT article_id, nullif(article_title, '') AS article_title, nullif(article_text, '') AS article_text,
        keywords, published_date FROM articles""",
        "articles",
    ),
    "sink_csv": sql(
        """SELECT article_language, count(class) AS total, count(*) FILTER (class = 'disinformation') AS disinformation,
        count(*) FILTER (class = 'support') AS support FROM articles GROUP BY 1""",
        "articles",
    ),
    "scan_jsonl_nested": sql(
        """SELECT article_id, article_text AS text, CASE WHEN label = 0 THEN 'real' ELSE 'fake' END AS label,
        article_language AS lang FROM labelled""",
        "labelled",
    ),
    "scan_cache_permissive": sql(
        """SELECT article_id, attempt, CAST(length(article_text) AS INT) AS chars FROM cache_log WHERE article_id % 7 <> 3
        UNION ALL SELECT -1, 0, CAST(count(*) AS INT) FROM cache_log WHERE article_id % 7 = 3""",
        "cache_log",
    ),
    "sink_append": sql("SELECT * FROM cache_log", "cache_log"),
    "collect_pending": "SELECT page_id AS article_id, url AS article_url FROM pages WHERE page_id % 4 <> 0",
    "collect_requests": """SELECT page_id AS article_id, concat('https://service.example/article?token=key&url=',
        replace(replace(replace(url_encode(url), '%20', '+'), '%2A', '*'), '~', '%7E'), '&timeout=60000') AS request FROM pages""",
    "collect_fetch": """SELECT page_id AS article_id, CASE WHEN page_id % 10 = 0 THEN 404 ELSE 200 END AS status,
        CASE WHEN page_id % 10 = 1 THEN 'fetch error' END AS error,
        CASE WHEN page_id % 10 IN (2, 3) THEN '' WHEN page_id % 10 <> 1 THEN html END AS text,
        CASE WHEN page_id % 10 <> 1 THEN 'a title' END AS title FROM pages WHERE page_id % 4 <> 0""",
    "archive_oldest": """SELECT url AS article_url, concat('archive/1/', url) AS archive_url FROM pages
        WHERE page_id % 10 IN (1, 2) GROUP BY url""",
    "collect_resolve": sql(
        """SELECT article_id, article_url, CASE WHEN outcome = 'ok' THEN first_text
        WHEN outcome IN ('ok_empty', 'ok_archive') THEN copied_text END AS article_text,
        CAST(NULL AS VARCHAR) AS article_title, outcome FROM decided""",
        **OUTCOMES,
    ),
    "collect_status_counts": sql(
        """SELECT outcome, count(*) AS n, CASE WHEN outcome LIKE 'failed%' THEN count(*) ELSE 0 END AS failed
        FROM (SELECT CASE WHEN article_id % 4 = 0 THEN 'cached' ELSE outcome END AS outcome FROM decided) GROUP BY outcome""",
        **OUTCOMES,
    ),
    "collect_finalize": sql(
        """SELECT * EXCLUDE (n_) FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY attempt) AS n_
        FROM cache_log) WHERE n_ = 1""",
        "cache_log",
    ),
    "collect_incremental": sql(
        """SELECT * FROM cache_log WHERE (attempt = 1 AND article_id % 5 <> 0)
        OR (attempt = 2 AND article_id % 5 = 0)""",
        "cache_log",
    ),
    "fill_nulls": sql(
        "SELECT article_id, coalesce(class, '') AS class, coalesce(keywords, '') AS keywords, article_title FROM articles",
        "articles",
    ),
    "drop_nulls": sql(
        "SELECT article_id, class, keywords FROM articles WHERE class IS NOT NULL AND keywords IS NOT NULL", "articles"
    ),
    "combine_title_text": sql(
        """SELECT article_id, CASE WHEN article_title <> '' THEN concat(article_title, ' ', article_text)
        ELSE article_text END AS text, article_language AS language FROM articles""",
        "articles",
    ),
    "binarize_label": sql(
        "SELECT article_id, CAST(label AS INT) AS is_disinformation, CAST(label AS INT) AS is_not_support FROM labelled",
        "labelled",
    ),
    "filter_isin": sql(
        "SELECT article_id, article_language FROM articles WHERE article_language IN ('en', 'es')", "articles"
    ),
    "filter_min_words": sql(
        f"""SELECT article_id, CAST(len({SPACE_TOKENS.format('article_text')}) AS INT) AS words FROM articles
        WHERE len({SPACE_TOKENS.format('article_text')}) > 10""",
        "articles",
    ),
    "map_codes": sql(
        f"SELECT article_id, article_language, c.name AS language FROM articles LEFT JOIN {CODE_VALUES} ON c.code = article_language",
        "articles",
    ),
    "filter_class_quarter": sql(
        f"""SELECT article_language, count(*) AS n FROM cases WHERE {quarter('debunk_date')} = '1997-Q3' AND class = 'F'
        GROUP BY 1""",
        "cases",
    ),
    "balanced_languages": sql(
        "SELECT article_language, article_id, class FROM labelled WHERE article_language IN (SELECT article_language FROM kept)",
        "labelled",
        **BALANCED,
    ),
    "prepared_articles": sql(
        "SELECT article_id, label, language, split, CAST(length(text) AS INT) AS chars FROM split_rows",
        "labelled",
        **BALANCED,
        source="""SELECT article_id, label, article_language AS language, CASE WHEN article_title <> ''
            THEN concat(article_title, ' ', article_text) ELSE article_text END AS text
            FROM labelled WHERE article_language IN (SELECT article_language FROM kept)""",
        **train_test("source", "article_id", ["label", "language"]),
    ),
    "prepared_nested_news": sql(
        "SELECT article_id, label, language, split FROM split_rows",
        "labelled",
        long=f"""SELECT article_id, label, c.name AS language FROM labelled JOIN {CODE_VALUES} ON c.code = article_language
            WHERE len({SPACE_TOKENS.format('article_text')}) > 10""",
        kept="""SELECT language FROM long GROUP BY 1 HAVING CAST(sum(label) AS DOUBLE) / count(*) < 0.9
            AND CAST(sum(label) AS DOUBLE) / count(*) > 1 - 0.9 AND count(*) > 40""",
        source="SELECT * FROM long WHERE language IN (SELECT language FROM kept)",
        **train_test("source", "article_id", ["label", "language"]),
    ),
    "prepared_flat_news": sql(
        "SELECT article_id, label, language, split FROM split_rows",
        "labelled",
        cells="""SELECT label, article_language AS language, [coalesce('=' || article_text, '-'),
            coalesce('=' || CAST(label AS VARCHAR), '-'), coalesce('=' || article_language, '-')] AS c FROM labelled""",
        contents="""SELECT label, language, md5(concat(array_to_string(list_transform(c, lambda x: CAST(length(x) AS VARCHAR)), '|'),
            '|', array_to_string(c, '|'))) AS content FROM cells""",
        named="""SELECT label, language, content || '-' || row_number() OVER (PARTITION BY content) AS article_id
            FROM contents""",
        kept="""SELECT language FROM named GROUP BY 1 HAVING CAST(sum(label) AS DOUBLE) / count(*) < 0.9
            AND CAST(sum(label) AS DOUBLE) / count(*) > 1 - 0.9 AND count(*) > 40""",
        source="SELECT * FROM named WHERE language IN (SELECT language FROM kept)",
        **train_test("source", "article_id", ["label", "language"]),
    ),
    "guard_outcomes": """SELECT 'documents' AS guard, 'ok' AS outcome, count(*) AS rows FROM documents
        UNION ALL SELECT 'no documents', 'no path', 0
        UNION ALL SELECT 'columns', 'ok', count(*) FROM labels
        UNION ALL SELECT 'no columns', 'no column', 0""",
    "quarter_languages": sql(
        f"""SELECT {quarter('debunk_date')} AS quarter, article_language, count(*) AS n FROM articles
        WHERE class = 'disinformation' AND debunk_date IS NOT NULL AND article_language IS NOT NULL GROUP BY 1, 2""",
        "articles",
    ),
    "value_counts": sql("SELECT class, count(*) AS n FROM articles WHERE class IS NOT NULL GROUP BY 1", "articles"),
    "distinct_counts": sql(
        """SELECT 'debunk_id' AS "column", count(DISTINCT debunk_id) AS n, 'skipped' AS nulls FROM articles
        UNION ALL SELECT 'article_publisher', count(DISTINCT article_publisher), 'skipped' FROM articles
        UNION ALL SELECT 'article_language', count(DISTINCT article_language), 'skipped' FROM articles
        UNION ALL SELECT 'class', count(DISTINCT class), 'skipped' FROM articles
        UNION ALL SELECT 'class', (SELECT count(*) FROM (SELECT DISTINCT class FROM articles)), 'counted'""",
        "articles",
    ),
    "cases_per_group": sql(
        """SELECT class, min(n) AS min_n, max(n) AS max_n, round(avg(n), 6) AS mean_n
        FROM (SELECT debunk_id, class, count(*) AS n FROM cases GROUP BY 1, 2) GROUP BY 1""",
        "cases",
    ),
    "mean_lengths": sql(
        """SELECT round(avg(length(article_text)), 6) AS mean_chars,
        round(avg(len(string_split(keywords, ','))), 6) AS mean_keywords FROM articles""",
        "articles",
    ),
    "language_quartiles": sql(
        """SELECT quantile_cont(total, 0.25) AS q25, quantile_cont(total, 0.5) AS q50, quantile_cont(total, 0.75) AS q75
        FROM (SELECT count(class) AS total FROM articles GROUP BY article_language)""",
        "articles",
    ),
    "support_share": sql(
        """SELECT article_language, round(CASE WHEN count(*) FILTER (class = 'support') > 0
        THEN CAST(count(*) FILTER (class = 'support') AS DOUBLE) / count(*) END, 6) AS share FROM articles GROUP BY 1""",
        "articles",
    ),
    "dense_language_class": sql(
        """SELECT l.article_language, c.class, count(x.article_id) AS n
        FROM (SELECT DISTINCT article_language FROM cases) l CROSS JOIN (VALUES ('F'), ('O'), ('P')) c(class)
        LEFT JOIN cases x ON x.article_language = l.article_language AND x.class = c.class GROUP BY 1, 2""",
        "cases",
    ),
    "date_span": sql(
        """SELECT CAST(a AS VARCHAR) AS first_date, CAST(b AS VARCHAR) AS last_date,
          CAST(m // 12 AS INT) AS years, CAST(m % 12 AS INT) AS months,
          CAST(date_diff('day', CAST(a + to_months(CAST(m AS INT)) AS DATE), b) AS INT) AS days
        FROM (SELECT a, b, m0 - CASE WHEN CAST(a + to_months(CAST(m0 AS INT)) AS DATE) > b THEN 1 ELSE 0 END AS m
          FROM (SELECT a, b, date_diff('month', a, b) AS m0
            FROM (SELECT min(debunk_date) AS a, max(debunk_date) AS b FROM cases)))""",
        "cases",
    ),
    "quarter_class_pivot": sql(
        f"""SELECT {quarter('debunk_date')} AS year_quarter, count(*) FILTER (class = 'F') AS "F",
        count(*) FILTER (class = 'O') AS "O", count(*) FILTER (class = 'P') AS "P" FROM cases GROUP BY 1""",
        "cases",
    ),
    "quarter_spine": sql(
        f"""SELECT s.year_quarter, count(*) FILTER (a.class = 'disinformation') AS disinformation,
        count(*) FILTER (a.class = 'support') AS support FROM spine s
        LEFT JOIN articles a ON {quarter('a.debunk_date')} = s.year_quarter GROUP BY 1""",
        "articles",
        ends="SELECT min(debunk_date) AS a, max(debunk_date) AS b FROM articles",
        days="""SELECT CAST(unnest(generate_series(date_trunc('quarter', a), date_trunc('quarter', b), INTERVAL 3 MONTH)) AS DATE) AS day,
            b FROM ends""",
        spine=f"""SELECT {quarter('day')} AS year_quarter FROM days
            WHERE CAST(day + INTERVAL 3 MONTH AS DATE) <= CAST(b + INTERVAL 1 DAY AS DATE)""",
    ),
    "quarter_keyword_pivot": sql(
        "SELECT q.year_quarter, "
        + ", ".join(
            f"count(*) FILTER (w.keyword = '{w.capitalize()}') AS \"{w}\"" for ws in TOPICS.values() for w in ws
        )
        + " FROM seen q LEFT JOIN words w ON w.year_quarter = q.year_quarter GROUP BY 1",
        "articles",
        quarters=f"SELECT DISTINCT {quarter('debunk_date')} AS year_quarter FROM articles",
        seen="SELECT year_quarter FROM quarters WHERE year_quarter < (SELECT max(year_quarter) FROM quarters)",
        raw_words=f"""SELECT {quarter('debunk_date')} AS year_quarter, unnest({KEYWORDS.format('keywords')}) AS k
            FROM articles WHERE class = 'disinformation' AND keywords IS NOT NULL""",
        words="SELECT year_quarter, concat(upper(left(k, 1)), lower(substr(k, 2))) AS keyword FROM raw_words",
    ),
    "publisher_class": sql(
        "SELECT article_publisher, class, count(*) AS n FROM articles WHERE class IS NOT NULL GROUP BY 1, 2", "articles"
    ),
    "publisher_share": sql(
        """SELECT count(*) FILTER (article_publisher LIKE '%rc1%') AS matching, count(*) AS total,
        round(CAST(count(*) FILTER (article_publisher LIKE '%rc1%') AS DOUBLE) / count(*), 6) AS share
        FROM articles WHERE class = 'disinformation'""",
        "articles",
    ),
    "top_keywords": sql(
        f"""SELECT keyword, count(*) AS n FROM (SELECT unnest({KEYWORDS.format('keywords')}) AS keyword
        FROM articles WHERE class = 'disinformation' AND keywords IS NOT NULL) GROUP BY 1 ORDER BY n DESC, keyword LIMIT 15""",
        "articles",
    ),
    "top_publishers": sql(
        """SELECT class, article_publisher, n, CAST("rank" AS INT) AS "rank" FROM (SELECT *, row_number() OVER
          (PARTITION BY class ORDER BY n DESC, article_publisher) AS "rank" FROM (
            SELECT class, article_publisher, count(*) AS n FROM articles WHERE class IS NOT NULL GROUP BY 1, 2))
        WHERE "rank" <= 25""",
        "articles",
    ),
    "topic_language_share": sql(
        """SELECT keyword, article_language, CAST(sum(n) AS BIGINT) AS n, round(CAST(sum(n) AS DOUBLE) / any_value(total), 6) AS share
        FROM (SELECT keyword, n, sum(n) OVER (PARTITION BY keyword) AS total, CASE WHEN row_number() OVER (
            PARTITION BY keyword ORDER BY n DESC, article_language) <= 2 THEN article_language ELSE 'Others' END AS article_language
          FROM pairs WHERE keyword IN (SELECT keyword FROM lead_words)) GROUP BY 1, 2""",
        "articles",
        exploded=f"SELECT article_language, unnest({KEYWORDS.format('keywords')}) AS keyword FROM articles WHERE keywords IS NOT NULL",
        pairs="SELECT keyword, article_language, count(*) AS n FROM exploded GROUP BY 1, 2",
        lead_words="SELECT keyword FROM pairs GROUP BY 1 ORDER BY sum(n) DESC, keyword LIMIT 15",
    ),
    "topk_lang_keyword": sql(
        """SELECT article_language, keyword, count(*) AS n,
          round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY article_language) * 100, 6) AS percent
        FROM exploded WHERE keyword IN (SELECT keyword FROM ks) AND article_language IN (SELECT article_language FROM ls)
        GROUP BY 1, 2""",
        "articles",
        exploded=f"SELECT article_language, unnest({KEYWORDS.format('keywords')}) AS keyword FROM articles WHERE keywords IS NOT NULL",
        ks="SELECT keyword FROM exploded GROUP BY 1 ORDER BY count(*) DESC, keyword LIMIT 8",
        ls="SELECT article_language FROM articles GROUP BY 1 ORDER BY count(*) DESC, article_language LIMIT 3",
    ),
    "top3_keywords_by_language": sql(
        """SELECT article_language, max(CASE WHEN r = 1 THEN keyword END) AS top1, max(CASE WHEN r = 2 THEN keyword END) AS top2,
          max(CASE WHEN r = 3 THEN keyword END) AS top3
        FROM (SELECT *, row_number() OVER (PARTITION BY article_language ORDER BY n DESC, keyword) AS r FROM (
          SELECT article_language, keyword, count(*) AS n FROM exploded
          WHERE article_language IN (SELECT article_language FROM ls) GROUP BY 1, 2)) GROUP BY 1""",
        "articles",
        exploded=f"SELECT article_language, unnest({KEYWORDS.format('keywords')}) AS keyword FROM articles WHERE keywords IS NOT NULL",
        ls="SELECT article_language FROM articles GROUP BY 1 ORDER BY count(*) DESC, article_language LIMIT 15",
    ),
    "scalar_text": sql(
        f"""SELECT article_id, array_to_string(list_transform({KEYWORDS.format('keywords')},
            lambda k: concat(upper(left(k, 1)), lower(substr(k, 2)))), ';') AS capitalized,
          replace(lower(keywords), 'ß', 'ss') AS folded, coalesce(CAST(len(string_split(keywords, ',')) AS INT), -1) AS listed,
          class || article_language AS stratum, CAST(length(article_text) AS INT) AS chars,
          CAST(len({SPACE_TOKENS.format('article_text')}) AS INT) AS words,
          article_publisher LIKE '%rc1%' AS matches,
          round(CAST(length(article_title) AS DOUBLE) / nullif(length(article_text), 0), 6) AS share FROM articles""",
        "articles",
    ),
    "scalar_dates": sql(
        f"""SELECT article_id, CAST(d AS VARCHAR) AS day, CAST(year(d) AS INT) AS year, CAST(quarter(d) AS INT) AS quarter,
          {quarter('d')} AS year_quarter,
          CAST(m0 - CASE WHEN CAST(DATE '1995-01-31' + to_months(CAST(m0 AS INT)) AS DATE) > d THEN 1 ELSE 0 END AS INT) AS months,
          CAST(len(list_filter(generate_series(TIMESTAMP '1994-10-01', CAST(d AS TIMESTAMP), INTERVAL 3 MONTH),
            lambda q: CAST(q + INTERVAL 3 MONTH AS DATE) <= CAST(d + INTERVAL 1 DAY AS DATE))) AS INT) AS quarters
        FROM (SELECT article_id, d, (year(d) - 1995) * 12 + month(d) - 1 AS m0
          FROM (SELECT article_id, CAST({DAY} AS DATE) AS d FROM articles))""",
        "articles",
    ),
    "tokenize": sql(
        f"""SELECT article_id, CAST(len(w) AS INT) AS tokens, CAST(len(list_distinct(w)) AS INT) AS types,
        md5(array_to_string(w, ' ')) AS digest FROM (SELECT article_id, {WORDS.format('article_text')} AS w FROM articles)""",
        "articles",
    ),
    "argmax_pred": """SELECT l_orderkey, CAST(CASE WHEN a >= n AND a >= r THEN 0 WHEN n >= r THEN 1 ELSE 2 END AS INT) AS pred
        FROM (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n,
        count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)""",
    "stratified_split": sql(
        "SELECT article_id, split FROM split_rows",
        "labelled",
        **train_test("labelled", "article_id", ["label", "article_language"]),
    ),
    "random_split": sql("SELECT article_id, split FROM split_rows", "cases", **train_test("cases", "article_id", [])),
    "stratified_kfold": sql(
        "SELECT article_id, fold FROM fold_rows", "cases", **folds("cases", "article_id", ["class", "article_language"])
    ),
    "temporal_split": sql(
        f"""SELECT article_id, event, CASE WHEN {DAY} < cutoff THEN 'train' ELSE 'test' END AS split
        FROM articles CROSS JOIN (VALUES {EVENT_VALUES}) AS t(event, cutoff)""",
        "articles",
    ),
    "topic_map": sql("SELECT article_id, keyword, topic FROM matches", "articles", **MATCHES),
    "topic_holdout": sql("SELECT article_id, held_out, split FROM held", "articles", **MATCHES),
    "sentences": sql(
        "SELECT article_id, CAST(pos AS INT) AS pos, array_to_string(words, ' ') AS sentence FROM sentences WHERE len(words) > 0",
        "articles",
        **SENTENCES,
    ),
    "ngram_counts": sql(
        """SELECT ngram, CAST(len(string_split(ngram, ' ')) AS INT) AS n, count(*) AS sentences FROM found
        GROUP BY ngram""",
        "articles",
        **SENTENCES,
        found=f"""SELECT unnest(list_distinct(list_concat({ngram_list('words', 3)},
            CASE WHEN len(words) > 3 THEN {ngram_list('words', 4)} ELSE [] END))) AS ngram FROM sentences WHERE len(words) > 2""",
    ),
    "cue_url_filter": sql(
        rf"""SELECT doc_id, CAST(pos AS INT) AS pos, regexp_replace(unnest(regexp_extract_all(raw, 'https?://[^\s<>"]+')),
            '[.,;:!?)\]]+$', '', 'g') AS url
        FROM words WHERE len(words) < 3 OR NOT list_has_any(list_concat({ngram_list('words', 3)},
            CASE WHEN len(words) > 3 THEN {ngram_list('words', 4)} ELSE [] END), {CUE_LIST})""",
        texts="""SELECT doc_id, replace(text, chr(10), concat(' https://news.example.org/', CAST(doc_id AS STRING), '.', chr(10))) AS text
            FROM documents""",
        pieces=r"""SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?]+\s+|\n+')) AS raw,
            generate_subscripts(regexp_split_to_array(text, '[.!?]+\s+|\n+'), 1) - 1 AS pos FROM texts""",
        words=f"SELECT doc_id, pos, raw, {SENTENCE_WORDS.format('raw')} AS words FROM pieces",
    ),
    "bow_counts": sql(
        """SELECT article_id, term, count(*) AS tf FROM test_words WHERE term IN (SELECT term FROM train_words) GROUP BY 1, 2""",
        "labelled",
        **SPLIT,
        train_words=f"SELECT DISTINCT unnest({WORDS.format('text')}) AS term FROM split_rows WHERE split = 'train'",
        test_words=f"SELECT article_id, unnest({WORDS.format('text')}) AS term FROM split_rows WHERE split = 'test'",
    ),
    "encode_fixed": sql(
        """SELECT article_id, array_to_string(list_concat(coalesce(ids, []), list_transform(generate_series(1, 512 - k), lambda i: 0)), ',') AS input_ids,
          array_to_string(list_concat(list_transform(generate_series(1, k), lambda i: 1),
            list_transform(generate_series(1, 512 - k), lambda i: 0)), ',') AS attention_mask
        FROM (SELECT t.article_id, e.ids, coalesce(len(e.ids), 0) AS k FROM terms t LEFT JOIN encoded e ON e.article_id = t.article_id)""",
        "articles",
        terms=f"SELECT article_id, {WORDS.format('article_text')} AS w FROM articles",
        vocabulary="""SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) + 1 AS id
            FROM (SELECT unnest(w) AS term FROM terms) GROUP BY term""",
        positions="SELECT article_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM terms",
        encoded="""SELECT p.article_id, list(v.id ORDER BY p.pos) AS ids FROM positions p JOIN vocabulary v ON v.term = p.term
            WHERE p.pos <= 512 GROUP BY 1""",
    ),
    "naive_bayes": sql(
        """SELECT id AS article_id, model, alpha, CAST(label AS INT) AS label, language, CAST(pred AS INT) AS pred,
        round(score_0, 3) AS score_0, round(score_1, 3) AS score_1 FROM nb""",
        "labelled",
        **SPLIT,
        **naive_bayes(one_model("train"), one_model("test"), [0.1]),
    ),
    "grid_search_nb": sql(
        """SELECT s.alpha, round(s.score, 6) AS score, CAST(CASE WHEN c.alpha IS NULL THEN 0 ELSE 1 END AS INT) AS chosen
        FROM searched s LEFT JOIN chosen c ON c.alpha = s.alpha""",
        "labelled",
        **SEARCH,
    ),
    "best_parameters": sql("SELECT alpha FROM chosen", "labelled", **SEARCH),
    "kfold_nb": sql(
        "SELECT language, round(avg(f1), 6) AS f1_mean, round(stddev_samp(f1), 6) AS f1_std FROM cells GROUP BY 1",
        "labelled",
        **KFOLD,
    ),
    "linear_svm": sql(
        """SELECT id AS article_id, model, cost, CAST(label AS INT) AS label, language, round(margin, 3) AS margin,
        CAST(pred AS INT) AS pred FROM svm""",
        "labelled",
        **SPLIT,
        **linear_svm(one_model("train"), one_model("test"), [0.1]),
    ),
    "grid_search_svm": sql(
        """SELECT s.cost, round(s.score, 6) AS score, CAST(CASE WHEN c.cost IS NULL THEN 0 ELSE 1 END AS INT) AS chosen
        FROM searched s LEFT JOIN chosen c ON c.cost = s.cost""",
        "labelled",
        **SVM_SEARCH,
    ),
    "kfold_svm": sql(
        "SELECT language, round(avg(f1), 6) AS f1_mean, round(stddev_samp(f1), 6) AS f1_std FROM cells GROUP BY 1",
        "labelled",
        **SVM_KFOLD,
    ),
    "batch_score": sql(
        """SELECT article_id, CAST(CASE WHEN s1 > s0 THEN 1 ELSE 0 END AS INT) AS pred, round(s0, 3) AS score_0, round(s1, 3) AS score_1
        FROM (SELECT a.article_id, coalesce(s.s0, 0) AS s0, coalesce(s.s1, 0) AS s1 FROM articles a
          LEFT JOIN (SELECT w.article_id, sum(l.s0) AS s0, sum(l.s1) AS s1 FROM words w JOIN lexicon l ON l.term = w.term GROUP BY 1) s
          ON s.article_id = a.article_id)""",
        "labelled",
        seen=f"SELECT label, unnest({WORDS.format('article_text')}) AS term FROM labelled",
        counted="""SELECT term, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM seen GROUP BY 1""",
        lexicon="""SELECT term, ln((n0 + 1) / (sum(n0) OVER () + count(*) OVER ())) AS s0,
            ln((n1 + 1) / (sum(n1) OVER () + count(*) OVER ())) AS s1 FROM counted""",
        words=f"SELECT article_id, unnest({WORDS.format('article_text')}) AS term FROM articles",
    ),
    "cross_dataset_grid": sql("SELECT * FROM report", "labelled", **dataset_grid()),
    "relative_drop": sql(
        """SELECT x.train_dataset, x.test_dataset, round(x.f1, 6) AS f1_overall, round(b.f1, 6) AS baseline,
          round((b.f1 - x.f1) * 100 / nullif(b.f1, 0), 6) AS drop_percent
        FROM overall x JOIN overall b ON b.test_dataset = x.test_dataset AND b.train_dataset = b.test_dataset
        WHERE x.train_dataset <> x.test_dataset""",
        "labelled",
        **dataset_grid(),
    ),
    "cross_topic_report": topic_report(),
    "temporal_report": sql(
        """SELECT model AS event, concat('<', strftime(cutoff, '%d-%m-%Y')) AS train_period,
          concat('>=', strftime(cutoff, '%d-%m-%Y')) AS test_period, f1_avg, f1_weighted, f1_overall
        FROM report JOIN events_ ON event = model""",
        "labelled",
        **DATED,
        **naive_bayes(
            "SELECT event AS model, article_id AS id, label, article_text AS text FROM dated WHERE split = 'train'",
            """SELECT event AS model, article_id AS id, label, article_language AS language, article_text AS text
               FROM dated WHERE split = 'test'""",
            [0.1],
        ),
        **report("nb", ["model"]),
    ),
    "confusion_counts": sql(
        """SELECT language, class, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(support) AS BIGINT) AS support,
          CAST(sum(predicted) AS BIGINT) AS predicted FROM (
          SELECT language, label AS class, CASE WHEN label = pred THEN 1 ELSE 0 END AS tp, 1 AS support, 0 AS predicted FROM predictions
          UNION ALL SELECT language, pred, 0, 0, 1 FROM predictions) GROUP BY 1, 2""",
        "predictions",
    ),
    "f1_overall": sql("SELECT round(f1, 6) AS f1, n FROM scores", "predictions", **f1("predictions", [], "scores")),
    "f1_by_language": sql(
        "SELECT language, round(f1, 6) AS f1, n FROM scores", "predictions", **f1("predictions", ["language"], "scores")
    ),
    "f1_language_avg": sql(
        """SELECT dataset, round(avg(f1), 6) AS f1_avg, round(sum(f1 * n) / sum(n), 6) AS f1_weighted FROM scores GROUP BY 1""",
        "predictions",
        **f1("predictions", ["dataset", "language"], "scores"),
    ),
    "group_support": sql(
        "SELECT language, count(*) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 6) AS weight FROM predictions GROUP BY 1",
        "predictions",
    ),
    "precision_recall": sql(
        "SELECT language, "
        + ", ".join(
            f"round(coalesce(CAST(count(*) FILTER (label = {c} AND pred = {c}) AS DOUBLE) / nullif(count(*) FILTER ({side} = {c}), 0), 0), 6) AS {name}_{c}"
            for name, side in (("precision", "pred"), ("recall", "label"))
            for c in (0, 1)
        )
        + " FROM predictions GROUP BY 1",
        "predictions",
    ),
    "fold_mean_std": sql(
        "SELECT language, round(avg(f1), 6) AS f1_mean, round(stddev_samp(f1), 6) AS f1_std FROM cells GROUP BY 1",
        "predictions",
        **F1_CELLS,
    ),
    "experiment_report": sql("SELECT * FROM report", "predictions", **report("predictions", ["dataset"])),
    "metric_log": sql(
        """SELECT dataset AS run, 'f1_avg' AS metric, f1_avg AS value FROM report
        UNION ALL SELECT dataset, 'f1_weighted', f1_weighted FROM report
        UNION ALL SELECT dataset, 'f1_overall', f1_overall FROM report""",
        "predictions",
        **report("predictions", ["dataset"]),
    ),
    "cv_report": sql(
        """SELECT language AS "row", round(m, 6) AS f1_mean, round(s, 6) AS f1_std, round(w, 6) AS weight FROM means
        UNION ALL SELECT 'Weighted F1', round(sum(m * w), 6), NULL, NULL FROM means
        UNION ALL SELECT 'Avg. F1', round(avg(m), 6), NULL, NULL FROM means
        UNION ALL SELECT 'Precision Negative', round(count(*) FILTER (label = 0 AND pred = 0) / CAST(count(*) FILTER (pred = 0) AS DOUBLE), 6), NULL, NULL FROM predictions
        UNION ALL SELECT 'Precision Positive', round(count(*) FILTER (label = 1 AND pred = 1) / CAST(count(*) FILTER (pred = 1) AS DOUBLE), 6), NULL, NULL FROM predictions
        UNION ALL SELECT 'Recall Negative', round(count(*) FILTER (label = 0 AND pred = 0) / CAST(count(*) FILTER (label = 0) AS DOUBLE), 6), NULL, NULL FROM predictions
        UNION ALL SELECT 'Recall Positive', round(count(*) FILTER (label = 1 AND pred = 1) / CAST(count(*) FILTER (label = 1) AS DOUBLE), 6), NULL, NULL FROM predictions""",
        "predictions",
        **f1("predictions", ["fold", "language"], "by_language"),
        weighted="SELECT fold, language, f1, n / CAST(sum(n) OVER (PARTITION BY fold) AS DOUBLE) AS w FROM by_language",
        means="SELECT language, avg(f1) AS m, stddev_samp(f1) AS s, avg(w) AS w FROM weighted GROUP BY 1",
    ),
}
ORACLE["language_distribution"] = ORACLE["sink_csv"]
ORACLE["scan_csv_split"] = ORACLE["scan_csv_roundtrip"]
ORACLE["collect_fetch_parallel"] = ORACLE["collect_fetch"]
ORACLE["model_roundtrip"] = ORACLE["naive_bayes"]
ORACLE["svm_roundtrip"] = sql(
    """SELECT id AS article_id, CAST(label AS INT) AS label, language, round(margin, 3) AS margin, CAST(pred AS INT) AS pred
    FROM svm""",
    "labelled",
    **SPLIT,
    **linear_svm(one_model("train"), one_model("test"), [0.1]),
)
