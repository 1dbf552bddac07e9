"""Resumable collection of article texts with an archive fallback."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.functions.text import url_query
from corpuslab.operators.joins import hot_key_lookup, pending_rows
from corpuslab.schemas import RESPONSE_BODY
from corpuslab.staging import stage

OK = 200
# Rows of about so many bytes are handed to a client at once, so that a worker holds the requests
# and responses of few rows, however large a batch of Spark is.
CLIENT_BYTES = 4 * 2**20

# Takes a batch of rows and returns one (status, body) pair per row. A failed request is
# (None, None).
Client = Callable[[pd.DataFrame], list[tuple[int | None, str | None]]]


def request_url(endpoint: str, url: Column, token: str, timeout_ms: int = 60_000) -> Column:
    """Address of an extraction request for ``url``."""
    query = url_query(
        {"token": F.lit(token), "url": url, "timeout": F.lit(str(timeout_ms))}
    )
    return F.concat(F.lit(endpoint + "?"), query)


def per_request(
    make_ask: Callable[[], Callable[[str], tuple[int, str]]], column: str = "request"
) -> Callable[[], Client]:
    """A client factory from a function that asks for one address; an error of it fails that row only."""

    def make_client() -> Client:
        ask = make_ask()

        def answer(address: str) -> tuple[int | None, str | None]:
            try:
                return ask(address)
            except Exception:
                return None, None

        return lambda batch: [answer(address) for address in batch[column]]

    return make_client


def fetch(
    pending: DataFrame, make_client: Callable[[], Client], partitions: int | None = None
) -> DataFrame:
    """Add ``status`` and ``body`` from an injected client, which is made once per partition.

    ``partitions`` sets how many clients work side by side. Stage the result before it is used
    twice, so that no address is requested again.
    """
    rows = pending.repartition(partitions) if partitions else pending
    schema = T.StructType(
        [
            *pending.schema.fields,
            T.StructField("status", T.IntegerType()),
            T.StructField("body", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make_client()
        for batch in batches:
            rows = max(1, batch.num_rows * CLIENT_BYTES // max(batch.nbytes, 1))
            for low in range(0, batch.num_rows, rows):
                part = batch.slice(low, rows)
                answers = client(part.to_pandas())
                status = pa.array(pd.array([a[0] for a in answers], dtype="Int32"))
                body = pa.array([a[1] for a in answers], pa.string(), from_pandas=True)
                yield pa.RecordBatch.from_arrays([*part.columns, status, body], names=names)

    names = schema.names
    return rows.mapInArrow(run, schema)


def parse_responses(fetched: DataFrame, row_id: str, body: str = "body") -> DataFrame:
    """(id, status, error, text, title) of JSON response bodies."""
    parsed = fetched.withColumn("_r", F.from_json(body, RESPONSE_BODY))
    first = F.get("_r.objects", F.lit(0))
    return parsed.select(
        row_id,
        "status",
        F.col("_r.error").alias("error"),
        first["text"].alias("text"),
        first["title"].alias("title"),
    )


def oldest_snapshots(snapshots: DataFrame, url: str, taken: str, archive_url: str) -> DataFrame:
    """(url, archive_url) of the earliest snapshot; ties go to the smaller address."""
    return snapshots.groupBy(url).agg(F.min(F.struct(taken, archive_url)).alias("_s")).select(
        url, F.col(f"_s.{archive_url}").alias(archive_url)
    )


def _needs_archive() -> Column:
    return (F.col("status") == OK) & ((F.col("text") == "") | F.col("error").isNotNull())


def locate_archive(
    pending: DataFrame,
    primary: DataFrame,
    oldest: DataFrame,
    row_id: str = "article_id",
    url: str = "article_url",
) -> DataFrame:
    """(id, archive_url) of the rows that need the archive and have a snapshot.

    ``oldest`` is (url, archive_url) with one row per address. Only ids and addresses go through the
    lookup, which holds up when one address belongs to most of the rows.
    """
    flags = primary.filter(_needs_archive()).select(row_id)
    needed = stage(pending.select(row_id, url).join(flags, row_id, "left_semi"), "needs-archive")
    found = hot_key_lookup(needed, oldest, url)
    return found.filter(F.col("archive_url").isNotNull()).select(row_id, "archive_url")


def resolve(
    pending: DataFrame,
    primary: DataFrame,
    located: DataFrame,
    archive: DataFrame,
    row_id: str = "article_id",
) -> DataFrame:
    """The outcome of every pending row as (base columns, article_text, article_title, outcome).

    ``primary`` and ``archive`` are (id, status, error, text, title) and ``located`` holds the ids
    with a snapshot, each with one row per id; everything is joined by id.
    """
    copies = archive.select(
        row_id, *[F.col(c).alias(f"a_{c}") for c in ("status", "error", "text", "title")]
    )
    found = located.select(row_id, F.lit(True).alias("in_archive")).join(copies, row_id, "left")
    answers = primary.select(
        row_id,
        F.col("status").alias("p_status"),
        _needs_archive().alias("fallback"),
        F.col("error").alias("p_error"),
        F.col("text").alias("p_text"),
        F.col("title").alias("p_title"),
    )
    rows = pending.join(answers, row_id, "left").join(found, row_id, "left")

    copied = F.coalesce(F.col("a_status") == OK, F.lit(False))
    fallback = F.coalesce(F.col("fallback"), F.lit(False))

    def used(name: str) -> Column:
        return F.when(fallback & copied, F.col(f"a_{name}")).otherwise(F.col(f"p_{name}"))

    outcome = (
        F.when(F.col("p_status").isNull(), "exception")
        .when(F.col("p_status") != OK, "http_skip")
        .when(fallback & F.col("in_archive").isNull(), "failed_no_archive")
        .when(fallback & F.col("a_status").isNull(), "exception")
        .when(fallback & used("error").isNotNull(), "failed_error")
        .when(used("text").isNull(), "exception")
        .when(used("text") == "", "ok_empty")
        .when(fallback, "ok_archive")
        .otherwise("ok")
    )
    stored = F.col("outcome").startswith("ok")
    return (
        rows.withColumn("outcome", outcome)
        .withColumn("article_text", F.when(stored, used("text")))
        .withColumn("article_title", F.when(stored, used("title")))
        .select(*pending.columns, "article_text", "article_title", "outcome")
    )


def outcome_counts(
    base: DataFrame, cache: DataFrame, resolved: DataFrame, row_id: str = "article_id"
) -> DataFrame:
    """(outcome, n, failed): rows per outcome, those found in the cache included."""
    done = base.select(row_id).join(cache.select(row_id).distinct(), row_id, "left_semi")
    rows = done.select(F.lit("cached").alias("outcome")).unionByName(resolved.select("outcome"))
    counts = rows.groupBy("outcome").agg(F.count("*").alias("n"))
    return counts.withColumn(
        "failed", F.when(F.col("outcome").startswith("failed"), F.col("n")).otherwise(F.lit(0))
    )


def new_cache_rows(resolved: DataFrame) -> DataFrame:
    """Rows to append to the cache: those with a text, even an empty one."""
    return resolved.filter(F.col("outcome").startswith("ok")).drop("outcome")


def finalize(cache: DataFrame, order: list[Column], row_id: str = "article_id") -> DataFrame:
    """The first cached row of every id.

    The rank filter is applied in each partition before the shuffle, so repeats of an id do not
    meet in one task.
    """
    first = Window.partitionBy(row_id).orderBy(*order)
    return cache.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


__all__ = [
    "fetch",
    "finalize",
    "locate_archive",
    "new_cache_rows",
    "oldest_snapshots",
    "outcome_counts",
    "parse_responses",
    "pending_rows",
    "per_request",
    "request_url",
    "resolve",
]
