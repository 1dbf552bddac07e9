"""Small frames with the cases that every operator has to take."""

import pyarrow.parquet as pq

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(folder=FOLDER):
    table = pq.read_table(f"{folder}/documents.parquet").to_pydict()
    return dict(zip(table["doc_id"], table["text"]))


def odd_rows():
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    long = "alpha beta gamma delta " * 6000 + "x" * 70_000
    return [
        (1, "one two  three", "en", "a", 14),
        (2, "one two\tthree", None, None, None),
        (3, None, "en", "a", None),
        (4, "", None, "b", 0),
        (5, long, "en", "b", len(long)),
        (None, "one two three", "en", "a", 13),
        (None, None, None, None, None),
        (1, "one two  three", "en", "a", 14),
        (1, "other text", "en", "a", 10),
        (6, " \n\t ", "en", "c", 4),
        (7, "MIT Licenseé the mit-license, GNU General\nPublic License", "en", "c", 50),
        (8, "\U0001f600 İstanbul ΣΑΣ <|endoftext|> a\x1cb", "fr", "c", 30),
    ]


def odd_frame(spark):
    """The rows with two more columns whose names clash with those of results."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(odd_rows(), SCHEMA)
    return frame.withColumn("row", F.lit(7)).withColumn("kept", F.lit("x")).withColumn("n", F.lit(1))


def empty_frame(spark):
    return spark.createDataFrame([], SCHEMA)
