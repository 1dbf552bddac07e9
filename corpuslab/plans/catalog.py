"""The query catalogue: every operator applied to the given tables."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.fixed_values import ALPHAS
from corpuslab.functions import dates, text
from corpuslab.functions.scores import argmax
from corpuslab.operators import (
    aggregate,
    bow,
    collect,
    evaluate,
    joins,
    models,
    naive_bayes,
    ngrams,
    prepare,
    score,
    splits,
    svm,
    topk,
)
from corpuslab.plans import experiments, views
from corpuslab.sources import readers, split_csv, writers
from corpuslab.staging import stage, work_path
from corpuslab.streaming.incremental import update_articles

Query = Callable[[SparkSession, str], DataFrame]

CLASSES = ["disinformation", "support"]
STATUSES = ["F", "O", "P"]
TOPICS = {
    "colour": ["red", "blue"],
    "heat": ["hot", "cold"],
    "age": ["new", "old"],
    "size": ["small", "large", "medium"],
}
SHOWN = {word.capitalize(): word for words in TOPICS.values() for word in words}
EVENTS = [("first", "01-01-1997"), ("second", "01-01-1999")]
CODES = {"en": "English", "fr": "French", "es": "Spanish"}
LANGUAGES = ["en", "fr", "de", "es"]
DATASETS = ["set0", "set1", "set2"]
# Bounds under which the synthetic languages are partly dropped.
BALANCE = {"threshold": 0.9, "min_articles": 40}
# Several splits of a text scan.
CSV_FILE_BYTES = 512 * 2**20
CUES = ["of the and", "the of the", "de la le", "the and of", "and the of the"]


def _day(name: str) -> Column:
    return F.col(name).cast("string").alias(name)


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _joined(name: str) -> Column:
    return F.array_join(name, ",").alias(name)


# Sources and sinks


def scan_csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    names = ["article_id", "article_title", "article_text", "keywords", "published_date"]
    path = work_path(spark, "articles-csv")
    writers.write_csv(views.articles(spark, folder).select(*names), path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = readers.read_csv(spark, path, schema)
    return rows.withColumn("article_id", F.col("article_id").cast("long"))


def scan_csv_split(spark: SparkSession, folder: str) -> DataFrame:
    """The same articles from one large file, cut into records by the tasks of a text scan.

    The file is written by one task that holds no rows; above ``CSV_FILE_BYTES`` of texts there are
    more such files, so that no task writes a growing part.
    """
    names = ["article_id", "article_title", "article_text", "keywords", "published_date"]
    path = work_path(spark, "articles-one-csv")
    texts = views.table(spark, folder, "documents").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, math.ceil(texts / CSV_FILE_BYTES))
    # Not ``coalesce``: it would run the join and its sorts in the writing tasks too.
    writers.write_csv(views.articles(spark, folder).select(*names).repartition(files, "article_id"), path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = split_csv.read_csv_splits(spark, path, schema)
    return rows.withColumn("article_id", F.col("article_id").cast("long"))


def sink_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = work_path(spark, "distribution-csv")
    writers.write_csv(language_distribution(spark, folder), path)
    schema = "article_language string, total long, disinformation long, support long"
    return readers.read_csv(spark, path, T.StructType.fromDDL(schema))


def scan_jsonl_nested(spark: SparkSession, folder: str) -> DataFrame:
    path = work_path(spark, "nested-json")
    rows = views.labelled(spark, folder).select(
        "article_id",
        F.struct(F.col("article_text").alias("text")).alias("ref_source"),
        F.when(F.col("label") == 0, "real").otherwise("fake").alias("label"),
        F.col("article_language").alias("lang"),
    )
    writers.append_json_lines(rows, path)
    schema = T.StructType(
        [
            T.StructField("article_id", T.LongType()),
            T.StructField("ref_source", T.StructType([T.StructField("text", T.StringType())])),
            T.StructField("label", T.StringType()),
            T.StructField("lang", T.StringType()),
        ]
    )
    scanned = readers.read_json_lines(spark, path, schema)
    return scanned.select("article_id", F.col("ref_source.text").alias("text"), "label", "lang")


CACHE_SCHEMA = T.StructType(
    [
        T.StructField("article_id", T.LongType()),
        T.StructField("article_url", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("article_text", T.StringType()),
    ]
)


def scan_cache_permissive(spark: SparkSession, folder: str) -> DataFrame:
    """Cached rows; every seventh line was cut off while it was written."""
    path = work_path(spark, "cache-text")
    log = views.cache_log(spark, folder)
    line = F.to_json(F.struct(*log.columns))
    broken = F.substr(line, F.lit(1), F.length(line) - 5)
    lines = log.select(F.when(F.col("article_id") % 7 == 3, broken).otherwise(line).alias("value"))
    lines.write.text(path)
    good, bad = readers.read_cache(spark, path, CACHE_SCHEMA)
    marked = good.select("article_id", "attempt", F.length("article_text").alias("chars"))
    lost = bad.agg(F.count("*").alias("chars")).select(
        F.lit(-1).cast("long").alias("article_id"), F.lit(0).alias("attempt"), F.col("chars").cast("int")
    )
    return marked.unionByName(lost)


def sink_append(spark: SparkSession, folder: str) -> DataFrame:
    """The cache after two appends."""
    path = work_path(spark, "cache-append")
    log = views.cache_log(spark, folder)
    for attempt in (1, 2):
        writers.append_json_lines(log.filter(F.col("attempt") == attempt), path)
    return readers.read_json_lines(spark, path, CACHE_SCHEMA)


# Collection


def collect_pending(spark: SparkSession, folder: str) -> DataFrame:
    return collect.pending_rows(
        views.crawl_base(spark, folder), views.crawl_cache(spark, folder), "article_id"
    )


def collect_requests(spark: SparkSession, folder: str) -> DataFrame:
    """The address of the extraction request of every page."""
    request = collect.request_url("https://service.example/article", F.col("article_url"), "key")
    return views.crawl_base(spark, folder).select("article_id", request.alias("request"))


def collect_fetch(
    spark: SparkSession, folder: str, partitions: int | None = None
) -> DataFrame:
    """Responses from a client that answers from the columns of the row, not from the network."""

    # Defined here, so that it is sent to the workers by value.
    def make_client():
        return lambda batch: list(
            zip(batch["stored_status"].tolist(), batch["stored_body"].tolist())
        )

    pending = collect_pending(spark, folder)
    stored = views.primary_responses(spark, folder)
    item = F.struct("text", F.lit("a title").alias("title"))
    body = F.when(F.col("error").isNotNull(), F.to_json(F.struct("error"))).otherwise(
        F.to_json(F.struct(F.array(item).alias("objects")))
    )
    answers = stored.select(
        "article_id", F.col("status").alias("stored_status"), body.alias("stored_body")
    )
    fetched = collect.fetch(pending.join(answers, "article_id"), make_client, partitions)
    return collect.parse_responses(fetched, "article_id")


def collect_fetch_parallel(spark: SparkSession, folder: str) -> DataFrame:
    """The same responses from twelve clients side by side."""
    return collect_fetch(spark, folder, partitions=12)


def archive_oldest(spark: SparkSession, folder: str) -> DataFrame:
    return collect.oldest_snapshots(
        views.snapshots(spark, folder), "article_url", "ts", "archive_url"
    )


def _resolved(spark: SparkSession, folder: str, pending: DataFrame) -> DataFrame:
    primary = views.primary_responses(spark, folder)
    oldest = archive_oldest(spark, folder).filter(~F.col("article_url").endswith("7"))
    located = collect.locate_archive(pending, primary, oldest)
    return collect.resolve(pending, primary, located, views.archive_responses(spark, folder))


def collect_resolve(spark: SparkSession, folder: str) -> DataFrame:
    return _resolved(spark, folder, views.crawl_base(spark, folder))


def collect_status_counts(spark: SparkSession, folder: str) -> DataFrame:
    base, cache = views.crawl_base(spark, folder), views.crawl_cache(spark, folder)
    pending = collect.pending_rows(base, cache, "article_id")
    return collect.outcome_counts(base, cache, _resolved(spark, folder, pending))


def collect_finalize(spark: SparkSession, folder: str) -> DataFrame:
    return collect.finalize(views.cache_log(spark, folder), [F.asc("attempt")])


def collect_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """The article table after two rounds of new cache files."""
    cache, table = work_path(spark, "stream-cache"), work_path(spark, "stream-articles")
    progress = work_path(spark, "stream-progress")
    log = views.cache_log(spark, folder)
    result = None
    for attempt in (1, 2):
        part = log.filter(F.col("attempt") == attempt)
        late = F.col("article_id") % 5 == 0
        part = part.filter(~late) if attempt == 1 else part
        writers.append_json_lines(part, cache)
        result = update_articles(
            spark, cache, CACHE_SCHEMA, table, progress, [F.asc("attempt"), F.asc("article_text")]
        )
    return result


# Projections and filters


def fill_nulls(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.articles(spark, folder).select("article_id", "class", "keywords", "article_title")
    return prepare.fill_nulls(rows)


def drop_nulls(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.articles(spark, folder).select("article_id", "class", "keywords")
    return prepare.drop_nulls(rows, "class", "keywords")


def combine_title_text(spark: SparkSession, folder: str) -> DataFrame:
    return views.articles(spark, folder).select(
        "article_id",
        prepare.combine_title_text(F.col("article_title"), F.col("article_text")).alias("text"),
        F.col("article_language").alias("language"),
    )


def binarize_label(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("class")
    return views.articles(spark, folder).filter(kind.isNotNull()).select(
        "article_id",
        prepare.binarize(kind, positive="disinformation").alias("is_disinformation"),
        prepare.binarize(kind, negative="support").alias("is_not_support"),
    )


def filter_isin(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.articles(spark, folder).select("article_id", "article_language")
    return rows.filter(F.col("article_language").isin("en", "es"))


def filter_min_words(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.articles(spark, folder).filter(prepare.has_min_words(F.col("article_text")))
    return rows.select("article_id", F.size(text.space_tokens(F.col("article_text"))).alias("words"))


def map_codes(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.articles(spark, folder).select("article_id", "article_language")
    return prepare.map_codes(rows, "article_language", CODES, "language")


def filter_class_quarter(spark: SparkSession, folder: str) -> DataFrame:
    quarter = dates.year_quarter(F.col("debunk_date"))
    rows = views.cases(spark, folder).filter((quarter == "1997-Q3") & (F.col("class") == "F"))
    return aggregate.value_counts(rows, "article_language")


def balanced_languages(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.labelled(spark, folder).select("article_id", "article_language", "class")
    return prepare.keep_balanced_languages(rows, "article_language", "class", CLASSES, **BALANCE)


def prepared_articles(spark: SparkSession, folder: str) -> DataFrame:
    """The experiment table with its train and test part."""
    rows = experiments.prepare_articles(views.articles(spark, folder), **BALANCE)
    return rows.select("article_id", "label", "language", "split", F.length("text").alias("chars"))


def prepared_nested_news(spark: SparkSession, folder: str) -> DataFrame:
    """The nested collection after the code, length and balance filters."""
    news = views.labelled(spark, folder).select(
        "article_id",
        F.struct(F.col("article_text").alias("text")).alias("ref_source"),
        F.when(F.col("label") == 0, "real").otherwise("fake").alias("label"),
        F.col("article_language").alias("lang"),
    )
    rows = experiments.prepare_nested_news(news, "article_id", CODES, **BALANCE)
    return rows.select("article_id", "label", "language", "split")


def prepared_flat_news(spark: SparkSession, folder: str) -> DataFrame:
    """The flat collection with ids from its content, after the balance filter."""
    news = views.labelled(spark, folder).select(
        "article_text", F.col("label").alias("class"), "article_language"
    )
    named = stage(prepare.with_stable_ids(news, ["article_text", "class", "article_language"]), "flat")
    rows = experiments.prepare_flat_news(named, "article_id", **BALANCE)
    return rows.select("article_id", "label", "language", "split")


def guard_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """(guard, outcome, rows): what the checks of inputs say, and the rows behind those that pass."""

    def asked(guard: str, check: Callable[[], DataFrame]) -> DataFrame:
        labels = [F.lit(guard).alias("guard")]
        try:
            rows = check()
        except (FileNotFoundError, ValueError) as error:
            outcome = "no path" if isinstance(error, FileNotFoundError) else "no column"
            return spark.range(1).select(*labels, F.lit(outcome).alias("outcome"), F.lit(0).cast("long").alias("rows"))
        return rows.agg(F.count("*").alias("rows")).select(*labels, F.lit("ok").alias("outcome"), "rows")

    def table(name: str) -> DataFrame:
        return spark.read.parquet(readers.require_path(spark, f"{folder}/{name}.parquet", "The test tables."))

    return (
        asked("documents", lambda: table("documents"))
        .unionByName(asked("no documents", lambda: table("no_documents")))
        .unionByName(asked("columns", lambda: readers.require_columns(table("labels"), "doc_id", "toxic")))
        .unionByName(asked("no columns", lambda: readers.require_columns(table("labels"), "doc_id", "keywords")))
    )


# Descriptive reports


def quarter_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of one class in every quarter."""
    rows = views.articles(spark, folder).filter(F.col("class") == CLASSES[0])
    return aggregate.quarter_value_counts(rows, "debunk_date", "article_language")


def value_counts(spark: SparkSession, folder: str) -> DataFrame:
    return aggregate.value_counts(views.articles(spark, folder), "class")


def distinct_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.articles(spark, folder)
    names = ["debunk_id", "article_publisher", "article_language", "class"]
    without = aggregate.distinct_counts(rows, names).withColumn("nulls", F.lit("skipped"))
    counted = aggregate.distinct_counts(rows, ["class"], count_null=True)
    return without.unionByName(counted.withColumn("nulls", F.lit("counted")))


def cases_per_group(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.cases(spark, folder)
    return _rounded(aggregate.cases_per_group(rows, "debunk_id", "class"), "mean_n")


def mean_lengths(spark: SparkSession, folder: str) -> DataFrame:
    report = aggregate.mean_lengths(views.articles(spark, folder), "article_text", "keywords")
    return _rounded(report, "mean_chars", "mean_keywords")


def language_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return aggregate.language_distribution(
        views.articles(spark, folder), "article_language", "class", CLASSES
    )


def language_quartiles(spark: SparkSession, folder: str) -> DataFrame:
    return aggregate.language_quartiles(
        views.articles(spark, folder), "article_language", "class", CLASSES
    )


def support_share(spark: SparkSession, folder: str) -> DataFrame:
    shares = aggregate.class_share(
        views.articles(spark, folder), "article_language", "class", "support"
    )
    return _rounded(shares, "share")


def dense_language_class(spark: SparkSession, folder: str) -> DataFrame:
    return aggregate.dense_language_class(
        views.cases(spark, folder), "article_language", "class", STATUSES
    )


def date_span(spark: SparkSession, folder: str) -> DataFrame:
    span = aggregate.date_span(views.cases(spark, folder), "debunk_date")
    return span.select(_day("first_date"), _day("last_date"), "years", "months", "days")


def quarter_class_pivot(spark: SparkSession, folder: str) -> DataFrame:
    return aggregate.quarter_class_pivot(
        views.cases(spark, folder), "debunk_date", "class", STATUSES
    )


def quarter_spine(spark: SparkSession, folder: str) -> DataFrame:
    """Counts per class on every finished quarter, also on those without an article."""
    rows = views.articles(spark, folder).select("class", "debunk_date")
    counts = aggregate.quarter_class_pivot(rows, "debunk_date", "class", CLASSES)
    return aggregate.fill_quarters(counts, aggregate.quarter_spine(rows, "debunk_date"))


def quarter_keyword_pivot(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.articles(spark, folder).select("class", "debunk_date", "keywords")
    return aggregate.quarter_keyword_pivot(
        rows.filter(F.col("class") == "disinformation"),
        "debunk_date",
        "keywords",
        SHOWN,
        aggregate.seen_quarters(rows, "debunk_date"),
    )


def publisher_class(spark: SparkSession, folder: str) -> DataFrame:
    return aggregate.group_class_counts(views.articles(spark, folder), "article_publisher", "class")


def publisher_share(spark: SparkSession, folder: str) -> DataFrame:
    report = aggregate.publisher_share(
        views.articles(spark, folder), "article_publisher", "class", "disinformation", "rc1"
    )
    return _rounded(report, "share")


def top_keywords(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.articles(spark, folder).filter(F.col("class") == "disinformation")
    return topk.top_values(topk.explode_keywords(rows, "keywords"), "keyword", 15)


def top_publishers(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_publishers(views.articles(spark, folder), "article_publisher", "class", 25)


def topic_language_share(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.articles(spark, folder)
    shares = topk.topic_language_share(rows, "keywords", "article_language", 15, 2)
    return _rounded(shares, "share")


def topk_lang_keyword(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.articles(spark, folder)
    counts = topk.top_language_keywords(rows, "keywords", "article_language", 8, 3)
    return _rounded(counts, "percent")


def top3_keywords_by_language(spark: SparkSession, folder: str) -> DataFrame:
    return topk.leading_keywords_by_language(
        views.articles(spark, folder), "keywords", "article_language", 15, 3
    )


# Scalar functions


def scalar_text(spark: SparkSession, folder: str) -> DataFrame:
    words = text.keyword_list(F.col("keywords"))
    return views.articles(spark, folder).select(
        "article_id",
        F.array_join(F.transform(words, text.capitalize), ";").alias("capitalized"),
        text.casefold(F.col("keywords")).alias("folded"),
        F.size(F.split("keywords", ",")).alias("listed"),
        F.concat("class", "article_language").alias("stratum"),
        F.length("article_text").alias("chars"),
        F.size(text.space_tokens(F.col("article_text"))).alias("words"),
        F.col("article_publisher").rlike("rc1").alias("matches"),
        F.round(text.ratio(F.length("article_title"), F.length("article_text")), 6).alias("share"),
    ).na.fill(-1, subset=["listed"])


def scalar_dates(spark: SparkSession, folder: str) -> DataFrame:
    day = dates.parse_day_first(F.col("published_date"))
    first = F.lit("31-01-1995")
    months = dates.whole_months(dates.parse_day_first(first), day)
    return views.articles(spark, folder).select(
        "article_id",
        day.cast("string").alias("day"),
        F.year(day).alias("year"),
        F.quarter(day).alias("quarter"),
        dates.year_quarter(day).alias("year_quarter"),
        months.alias("months"),
        F.size(dates.quarter_starts(dates.parse_day_first(F.lit("15-11-1994")), day)).alias("quarters"),
    )


def tokenize(spark: SparkSession, folder: str) -> DataFrame:
    words = text.word_tokens(F.col("article_text"))
    return views.articles(spark, folder).select(
        "article_id",
        F.size(words).alias("tokens"),
        F.size(F.array_distinct(words)).alias("types"),
        F.md5(F.array_join(words, " ")).alias("digest"),
    )


def argmax_pred(spark: SparkSession, folder: str) -> DataFrame:
    """Class with the highest score, from three scores with many ties."""
    rows = views.table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        *[F.count_if(F.col("l_returnflag") == flag).alias(flag) for flag in ("A", "N", "R")]
    )
    return rows.select("l_orderkey", argmax(F.array("A", "N", "R")).alias("pred"))


# Splits


def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.labelled(spark, folder).select("article_id", "label", "article_language")
    split = splits.train_test_split(rows, "article_id", ["label", "article_language"])
    return split.select("article_id", "split")


def random_split(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.cases(spark, folder).select("article_id")
    return splits.train_test_split(rows, "article_id")


def stratified_kfold(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.cases(spark, folder).select("article_id", "class", "article_language")
    folds = splits.stratified_folds(rows, "article_id", ["class", "article_language"])
    return folds.select("article_id", "fold")


def temporal_split(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.articles(spark, folder).select("article_id", "published_date")
    return splits.temporal_split(rows, "published_date", EVENTS).select(
        "article_id", "event", "split"
    )


def topic_map(spark: SparkSession, folder: str) -> DataFrame:
    return joins.topic_matches(views.articles(spark, folder), "article_id", "keywords", TOPICS)


def topic_holdout(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.articles(spark, folder).select("article_id", "keywords")
    return splits.topic_holdout(rows, "keywords", TOPICS).select("article_id", "held_out", "split")


# Text features


def sentences(spark: SparkSession, folder: str) -> DataFrame:
    return ngrams.sentences(views.articles(spark, folder), "article_id", "article_text")


def ngram_counts(spark: SparkSession, folder: str) -> DataFrame:
    return ngrams.ngram_counts(views.articles(spark, folder), "article_id", "article_text")


def cue_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return ngrams.cue_free_urls(views.debunk_texts(spark, folder), "doc_id", "text", CUES)


def _split_articles(spark: SparkSession, folder: str) -> DataFrame:
    rows = stage(
        views.labelled(spark, folder).select(
            "article_id",
            F.col("article_text").alias("text"),
            "label",
            F.col("article_language").alias("language"),
            "keywords",
            "published_date",
        ),
        "labelled",
    )
    return splits.train_test_split(rows, "article_id", ["label", "language"])


def bow_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of the test texts over the vocabulary of the train texts."""
    rows = _split_articles(spark, folder)
    train, test = rows.filter(F.col("split") == "train"), rows.filter(F.col("split") == "test")
    return bow.counts_in_vocabulary(train, test, "article_id", "text")


def encode_fixed(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.articles(spark, folder).select("article_id", "article_text")
    vocabulary = bow.fit_vocabulary(rows, "article_text")
    encoded = bow.encode_fixed(rows, "article_id", "article_text", vocabulary)
    return encoded.select("article_id", _joined("input_ids"), _joined("attention_mask"))


# Models


def _predicted(rows: DataFrame, row_id: str = "article_id") -> DataFrame:
    return rows.select(
        F.col(row_id),
        "model",
        "alpha",
        "label",
        "language",
        "pred",
        *[F.round(F.col("scores")[i], 3).alias(f"score_{i}") for i in (0, 1)],
    )


def naive_bayes_query(spark: SparkSession, folder: str) -> DataFrame:
    rows = _split_articles(spark, folder)
    model = naive_bayes.Model("split", F.col("split") == "train", F.col("split") == "test")
    return _predicted(
        naive_bayes.predict(
            rows, [model], "article_id", "text", "label", "language", [0.1], few_scored=True
        )
    )


def grid_search_nb(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every smoothing value and whether it is the chosen one."""
    rows = _split_articles(spark, folder)
    scores = stage(
        naive_bayes.grid_search(rows, "article_id", "text", "label", "language", alphas=ALPHAS),
        "search",
    )
    best = naive_bayes.best_parameters(scores).select("alpha", F.lit(1).alias("chosen"))
    marked = scores.join(F.broadcast(best), "alpha", "left").na.fill(0, subset=["chosen"])
    return _rounded(marked.select("alpha", "score", "chosen"), "score")


def best_parameters(spark: SparkSession, folder: str) -> DataFrame:
    """The chosen smoothing value as read back from its JSON file."""
    path = work_path(spark, "best-json")
    rows = _split_articles(spark, folder)
    scores = naive_bayes.grid_search(rows, "article_id", "text", "label", "language")
    writers.write_best_parameters(naive_bayes.best_parameters(scores).select("alpha"), path)
    return readers.read_json_lines(spark, path, T.StructType.fromDDL("alpha double"))


def kfold_nb(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and deviation over ten folds of macro-F1 per language, and of the average."""
    rows = _split_articles(spark, folder).filter(F.col("split") == "train")
    predictions = experiments.cross_validate(
        rows, "article_id", "text", "label", "language", 0.1
    )
    scores = evaluate.with_average_row(evaluate.fold_scores(predictions))
    return _rounded(evaluate.fold_mean_std(scores), "f1_mean", "f1_std")


def linear_svm(spark: SparkSession, folder: str) -> DataFrame:
    """Margins and classes of the test texts at one cost."""
    rows = _split_articles(spark, folder)
    model = naive_bayes.Model("split", F.col("split") == "train", F.col("split") == "test")
    found = svm.train_and_predict(rows, [model], "article_id", "text", "label", "language", [0.1])
    return _rounded(found, "margin", digits=3)


def grid_search_svm(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every cost and whether it is the chosen one; all costs are fitted at once."""
    rows = _split_articles(spark, folder)
    scores = stage(svm.grid_search(rows, "article_id", "text", "label", "language"), "search")
    best = naive_bayes.best_parameters(scores).select("cost", F.lit(1).alias("chosen"))
    marked = scores.join(F.broadcast(best), "cost", "left").na.fill(0, subset=["chosen"])
    return _rounded(marked.select("cost", "score", "chosen"), "score")


def kfold_svm(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and deviation over ten folds of macro-F1 per language; all folds are fitted at once."""
    rows = _split_articles(spark, folder).filter(F.col("split") == "train")
    predictions = experiments.cross_validate_svm(rows, "article_id", "text", "label", "language", 0.1)
    scores = evaluate.with_average_row(evaluate.fold_scores(predictions))
    return _rounded(evaluate.fold_mean_std(scores), "f1_mean", "f1_std")


def _applied(spark: SparkSession, rows: DataFrame, model: models.TextModel) -> DataFrame:
    """Predictions of the test rows by the model as written and read back."""
    path = work_path(spark, "model")
    models.save_model(model, path)
    test = rows.filter(F.col("split") == "test")
    scored = models.apply_model(models.load_model(spark, path), test, "article_id", "text")
    return scored.join(test.select("article_id", "label", "language"), "article_id")


def model_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Naive Bayes fitted on the train part, stored, and applied to the test part."""
    rows = _split_articles(spark, folder)
    fitted = models.fit_naive_bayes(rows.filter(F.col("split") == "train"), "text", "label", 0.1)
    found = _applied(spark, rows, fitted).select("*", F.lit("split").alias("model"), F.lit(0.1).alias("alpha"))
    return _predicted(found)


def svm_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The linear SVM fitted on the train part, stored, and applied to the test part."""
    rows = _split_articles(spark, folder)
    train = rows.filter(F.col("split") == "train")
    found = _applied(spark, rows, models.fit_linear_svm(train, "article_id", "text", "label", 0.1))
    margin = F.round(F.col("scores")[1], 3).alias("margin")
    return found.select("article_id", "label", "language", margin, "pred")


def batch_score(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all articles by the weights of all terms of the labelled ones."""
    weights = score.term_weights(views.labelled(spark, folder), "article_text", "label")
    scored = score.score_terms(views.articles(spark, folder), weights, "article_id", "article_text")
    return scored.select(
        "article_id",
        "pred",
        *[F.round(F.col("scores")[i], 3).alias(f"score_{i}") for i in (0, 1)],
    )


def _dataset_articles(spark: SparkSession, folder: str) -> DataFrame:
    name = F.concat(F.lit("set"), (F.col("article_id") % 3).cast("string"))
    return stage(
        views.labelled(spark, folder).select(
            "article_id",
            F.col("article_text").alias("text"),
            "label",
            F.col("article_language").alias("language"),
            name.alias("dataset"),
        ),
        "datasets",
    )


def cross_dataset_grid(spark: SparkSession, folder: str) -> DataFrame:
    report = experiments.cross_datasets(_dataset_articles(spark, folder), DATASETS, "article_id")
    return _rounded(report, "f1_avg", "f1_weighted", "f1_overall")


def relative_drop(spark: SparkSession, folder: str) -> DataFrame:
    grid = stage(
        experiments.cross_datasets(_dataset_articles(spark, folder), DATASETS, "article_id"), "grid"
    )
    drops = evaluate.relative_drop(grid, "train_dataset", "test_dataset", "f1_overall")
    return _rounded(drops, "f1_overall", "baseline", "drop_percent")


def cross_topic_report(spark: SparkSession, folder: str) -> DataFrame:
    report = experiments.cross_topics(_split_articles(spark, folder), TOPICS, "article_id")
    return _rounded(report, "f1_avg", "f1_weighted", "f1_overall")


def temporal_report(spark: SparkSession, folder: str) -> DataFrame:
    rows = _split_articles(spark, folder)
    report = experiments.temporal_splits(rows, "article_id", events=EVENTS)
    return _rounded(report, "f1_avg", "f1_weighted", "f1_overall")


# Evaluation


def confusion_counts(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.confusion_counts(views.predictions(spark, folder), ["language"])


def f1_overall(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(evaluate.macro_f1(views.predictions(spark, folder), []), "f1")


def f1_by_language(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(evaluate.macro_f1(views.predictions(spark, folder), ["language"]), "f1")


def f1_language_avg(spark: SparkSession, folder: str) -> DataFrame:
    rows = evaluate.macro_f1(views.predictions(spark, folder), ["dataset", "language"])
    return _rounded(evaluate.language_average(rows, ["dataset"]), "f1_avg", "f1_weighted")


def group_support(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(
        aggregate.group_support_share(views.predictions(spark, folder), "language"), "weight"
    )


def precision_recall(spark: SparkSession, folder: str) -> DataFrame:
    report = evaluate.precision_recall(views.predictions(spark, folder), ["language"])
    return _rounded(report, "precision_0", "precision_1", "recall_0", "recall_1")


def fold_mean_std(spark: SparkSession, folder: str) -> DataFrame:
    """Fold scores as columns, stacked again, and their mean and deviation."""
    scores = evaluate.fold_scores(views.predictions(spark, folder))
    wide = evaluate.folds_as_columns(evaluate.with_average_row(scores), list(range(5)))
    return _rounded(evaluate.fold_mean_std(evaluate.stack_folds(wide)), "f1_mean", "f1_std")


def experiment_report(spark: SparkSession, folder: str) -> DataFrame:
    report = evaluate.experiment_report(views.predictions(spark, folder), ["dataset"])
    return _rounded(report, "f1_avg", "f1_weighted", "f1_overall")


def metric_log(spark: SparkSession, folder: str) -> DataFrame:
    """The metrics table after one run per dataset."""
    path = work_path(spark, "metrics")
    report = stage(experiment_report(spark, folder), "report")
    for name in DATASETS:
        row = report.filter(F.col("dataset") == name).drop("dataset")
        writers.log_metrics(spark, path, name, row)
    return spark.read.parquet(path)


def cv_report(spark: SparkSession, folder: str) -> DataFrame:
    rows = stage(views.predictions(spark, folder), "predictions")
    report = evaluate.cv_report(rows, LANGUAGES)
    return _rounded(report, "f1_mean", "f1_std", "weight").drop("position")


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in [
        scan_csv_roundtrip, scan_csv_split, sink_csv, scan_jsonl_nested, scan_cache_permissive, sink_append,
        collect_pending, collect_requests, collect_fetch, collect_fetch_parallel, archive_oldest, collect_resolve, collect_status_counts,
        collect_finalize, collect_incremental, fill_nulls, drop_nulls, combine_title_text,
        binarize_label, filter_isin, filter_min_words, map_codes, filter_class_quarter,
        balanced_languages, prepared_articles, prepared_nested_news, prepared_flat_news, guard_outcomes,
        quarter_languages, value_counts, distinct_counts,
        cases_per_group, mean_lengths, language_distribution, language_quartiles, support_share,
        dense_language_class, date_span, quarter_class_pivot, quarter_spine, quarter_keyword_pivot,
        publisher_class, publisher_share, top_keywords, top_publishers, topic_language_share,
        topk_lang_keyword, top3_keywords_by_language, scalar_text, scalar_dates, tokenize,
        argmax_pred, stratified_split, random_split, stratified_kfold, temporal_split, topic_map,
        topic_holdout, sentences, ngram_counts, cue_url_filter, bow_counts, encode_fixed,
        grid_search_nb, best_parameters, kfold_nb, linear_svm, grid_search_svm, kfold_svm, model_roundtrip,
        svm_roundtrip, batch_score, cross_dataset_grid,
        relative_drop, cross_topic_report, temporal_report, confusion_counts, f1_overall,
        f1_by_language, f1_language_avg, group_support, precision_recall, fold_mean_std,
        experiment_report, metric_log, cv_report,
    ]
}
QUERIES["naive_bayes"] = naive_bayes_query
