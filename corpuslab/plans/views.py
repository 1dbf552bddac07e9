"""Article, prediction and collection views over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document with class, publisher, dates and keywords."""
    documents = table(spark, folder, "documents").alias("d")
    orders = table(spark, folder, "orders").alias("o")
    part = table(spark, folder, "part").alias("p")
    labels = table(spark, folder, "labels").alias("l")
    doc_id, day = F.col("d.doc_id"), F.col("o.o_orderdate").cast("date")
    joined = (
        documents.join(orders, F.col("o.o_orderkey") == doc_id)
        .join(part, F.col("p.p_partkey") == doc_id)
        .join(labels, F.col("l.doc_id") == doc_id, "left")
    )
    return joined.select(
        doc_id.alias("article_id"),
        F.col("d.text").alias("article_text"),
        F.when(doc_id % 5 == 0, "")
        .otherwise(F.split_part("d.text", F.lit("\n"), F.lit(1)))
        .alias("article_title"),
        F.col("d.lang").alias("article_language"),
        F.col("d.source").alias("article_publisher"),
        F.when(F.col("l.toxic") == 1, "disinformation")
        .when(F.col("l.toxic") == 0, "support")
        .alias("class"),
        F.floor(doc_id / 3).alias("debunk_id"),
        day.alias("debunk_date"),
        F.date_format(day, "dd-MM-yyyy").alias("published_date"),
        F.when(
            doc_id % 7 != 0,
            F.concat_ws(", ", F.replace("p.p_name", F.lit(" "), F.lit(", ")), "p.p_type"),
        ).alias("keywords"),
    )


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Articles with a class, and the class as a 0/1 label."""
    rows = articles(spark, folder).filter(F.col("class").isNotNull())
    return rows.withColumn("label", (F.col("class") == "disinformation").cast("int"))


def cases(spark: SparkSession, folder: str) -> DataFrame:
    """Many short rows of (debunk, class, language, date)."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("article_id"),
        F.col("o_custkey").alias("debunk_id"),
        F.col("o_orderstatus").alias("class"),
        F.col("o_orderpriority").alias("article_language"),
        F.col("o_orderdate").cast("date").alias("debunk_date"),
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Labels with a stand-in prediction; ``dataset`` and ``fold`` group the rows."""
    labels = table(spark, folder, "labels")
    documents = table(spark, folder, "documents").select("doc_id", F.col("lang").alias("language"))
    return labels.join(documents, "doc_id").select(
        "doc_id",
        "language",
        F.col("toxic").alias("label"),
        (1 - F.col("quality")).alias("pred"),
        F.concat(F.lit("set"), (F.col("doc_id") % 3).cast("string")).alias("dataset"),
        (F.col("doc_id") % 5).cast("int").alias("fold"),
    )


def crawl_base(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return pages.select(F.col("page_id").alias("article_id"), F.col("url").alias("article_url"))


def crawl_cache(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").filter(F.col("page_id") % 4 == 0)
    return pages.select(
        F.col("page_id").alias("article_id"),
        F.col("url").alias("article_url"),
        F.col("html").alias("article_text"),
    )


def cache_log(spark: SparkSession, folder: str) -> DataFrame:
    """Cache lines of all pages in two attempts; the second repeats every third page."""
    pages = table(spark, folder, "pages").select(
        F.col("page_id").alias("article_id"),
        F.col("url").alias("article_url"),
        F.lit(1).alias("attempt"),
        F.col("html").alias("article_text"),
    )
    again = pages.filter(F.col("article_id") % 3 == 0).select(
        "article_id",
        "article_url",
        F.lit(2).alias("attempt"),
        F.concat(F.lit("again "), "article_text").alias("article_text"),
    )
    return pages.unionByName(again)


def primary_responses(spark: SparkSession, folder: str) -> DataFrame:
    last = F.col("page_id") % 10
    return table(spark, folder, "pages").select(
        F.col("page_id").alias("article_id"),
        F.when(last == 0, 404).otherwise(200).alias("status"),
        F.when(last == 1, "fetch error").alias("error"),
        F.when(last.isin(2, 3), "").when(last != 1, F.col("html")).alias("text"),
        F.lit(None).cast("string").alias("title"),
    )


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").filter((F.col("page_id") % 10).isin(1, 2))
    taken = pages.select("url", F.explode(F.array(F.lit(3), F.lit(1), F.lit(2))).alias("ts"))
    return taken.select(
        F.col("url").alias("article_url"),
        F.concat(F.lit("archive/"), F.col("ts").cast("string"), F.lit("/"), "url").alias("archive_url"),
        "ts",
    )


def archive_responses(spark: SparkSession, folder: str) -> DataFrame:
    last = F.col("page_id") % 20
    pages = table(spark, folder, "pages").filter((F.col("page_id") % 10).isin(1, 2))
    return pages.select(
        F.col("page_id").alias("article_id"),
        F.lit(200).alias("status"),
        F.when(last == 11, "fetch error").alias("error"),
        F.when(last == 2, "").when(last != 11, F.col("html")).alias("text"),
        F.lit(None).cast("string").alias("title"),
    )


def debunk_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose every line ends with an address."""
    documents = table(spark, folder, "documents")
    address = F.concat(F.lit(" https://news.example.org/"), F.col("doc_id").cast("string"), F.lit(".\n"))
    return documents.select("doc_id", F.replace("text", F.lit("\n"), address).alias("text"))
