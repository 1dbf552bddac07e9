"""What several operators share: reading, staging, tokenizer files, packed row numbers."""

from __future__ import annotations

import functools
import json
from array import array

import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuslab.staging import work_path

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
# Row numbers are (partition << PART_BITS) + position in the partition.
PART_BITS = 33


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def row_key(doc_id: Column, content: Column) -> Column:
    """One column for doc_id and a hash of the content, so that a join and the dropping of repeated
    rows share one shuffle."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("none")), content.cast("string"))


def whole_row(docs: DataFrame, name: str = "_row") -> Column:
    """All columns in one struct, so that none can clash with a column that is worked with."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name)


def tokenizer_path(name: str) -> str:
    """Path of an installed public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder, well compressed, and read it back."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_numbers_from() -> int:
    """First row number of the running task; with staging, a retry gives the same rows."""
    return TaskContext.get().partitionId() << PART_BITS


@functools.lru_cache(maxsize=4)
def library_tokenizer(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves, the others for the characters from 256 on, in order.
    """
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class _Chunks(dict):
    """White-space chunk -> bytes of its ids. At ``limit`` entries, new ones are not kept."""

    def __init__(self, make, limit: int):
        self.make, self.limit = make, limit

    def __missing__(self, chunk):
        ids = self.make(chunk)
        if len(self) < self.limit and len(chunk) <= 40:
            self[chunk] = ids
        return ids


class ChunkEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers.

    The tokenizer drops white space before it splits words, so the ids of a text are those of its
    white-space chunks in turn. Every chunk and every word goes through the library once and is
    remembered in two dictionaries of at most ``limit`` entries; longer runs of new chunks are
    encoded each time. Texts in which a special token or a separator control occurs go through the
    library whole.
    """

    _WHOLE = regex.compile(r"<\||[\x1c-\x1f\x85]")
    _END = ".,!?;:"

    def __init__(self, path: str, limit: int = 600_000):
        config = json.load(open(path, encoding="utf-8"))
        steps = [s["type"] for s in (config["normalizer"] or {}).get("normalizers", [])]
        if steps != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path} keeps white space or letter case; chunks are not independent")
        self.library = library_tokenizer(path)
        self.chunks = _Chunks(self._chunk, limit)
        self.words = _Chunks(self._word, limit)
        self.ends = _Chunks(self._library, limit)
        self.letters = {i: c for i, c in enumerate(byte_letters())}

    def _library(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        core = chunk.rstrip(self._END)
        if core.isalpha() and (core.isascii() or max(core) < "İ"):
            ids = self.words[core.lower()]
            return ids + self.ends[chunk[len(core) :]] if len(core) < len(chunk) else ids
        return self._library(chunk)

    def _word(self, word: str) -> bytes:
        """Ids of lower-case letters of the first 304 code points, one word of the tokenizer."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.library.model.tokenize(word)]).tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self._WHOLE.search(text):
            return self._library(text)
        return b"".join(map(self.chunks.__getitem__, text.split()))


@functools.lru_cache(maxsize=2)
def chunk_encoder(path: str) -> ChunkEncoder:
    """One encoder per Python worker, kept from task to task."""
    return ChunkEncoder(path)
