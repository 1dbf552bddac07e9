"""Byte-pair encoding by dynamic programming over prefixes.

Of all encodings of a prefix, byte-pair merging gives exactly one, so the last token of every prefix
is unique. A suffix matcher over the vocabulary (one automaton state per prefix) names the tokens
that end at a place, longest first; the right one is the first that is compatible with the last
token of the prefix before it, that is, merging the two side by side never joins across their
border. The last tokens are stored, and following them back from the end emits the ids. A pre-token
is encoded on its own; frequent ones are remembered per Python worker, up to a stated number.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import byte_letters

# Fixed value: the published pre-token pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = 1 << 60


class _Memo(dict):
    """Pre-token -> ids; at ``limit`` entries new ones are not kept."""

    def __init__(self, make, limit: int):
        self.make, self.limit = make, limit

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.make(piece.encode("utf-8", "surrogatepass"))
        if len(self) < self.limit and len(piece) <= 40:
            self[piece] = ids
        return ids


class PrefixBpe:
    """Encoder and decoder of a byte-level vocabulary file."""

    def __init__(self, path: str, limit: int = 400_000):
        config = json.load(open(path, encoding="utf-8"))
        model = config["model"]
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        as_bytes = lambda t: bytes(map(byte_of.__getitem__, t))
        self.bytes_of: dict[int, bytes] = {i: as_bytes(t) for t, i in model["vocab"].items()}
        ids = {t: i for t, i in model["vocab"].items()}
        # Merge (left, right) -> rank; token -> (rank that makes it, left, right).
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = (ids[left], ids[right])
            if ids[left + right] in self.made:
                raise ValueError(f"{path} makes one token by two merges")
            self.rank[pair] = rank
            self.made[ids[left + right]] = (rank, *pair)
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        for text, number in self.special.items():
            self.bytes_of[number] = text.encode()
        self._split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self._pieces = regex.compile(PATTERN)
        self._spines: dict[int, tuple[list, list]] = {}
        self._fits: dict[int, bool] = {}
        self.matcher = ahocorasick.Automaton()
        self.single = {}
        for token, i in model["vocab"].items():
            raw = self.bytes_of[i]
            if len(raw) == 1:
                self.single[raw] = i
            if len(raw) == 1 or i in self.made and self.compatible(*self.made[i][1:], self.made[i][0]):
                self.matcher.add_word(raw.decode("latin-1"), (i, len(raw)))
        self.matcher.make_automaton()
        self._fits.clear()
        self.memo = _Memo(self.encode_piece, limit)

    def _spine(self, token: int) -> tuple[list, list]:
        """(token, rank that uses it up) along the right and the left edge, bytes first."""
        found = self._spines.get(token)
        if found is None:
            edges = []
            for side in (2, 1):
                edge = [(token, NEVER)]
                while edge[-1][0] in self.made:
                    made = self.made[edge[-1][0]]
                    edge.append((made[side], made[0]))
                edges.append(edge[::-1])
            found = self._spines[token] = (edges[0], edges[1])
        return found

    def compatible(self, a: int, b: int, until: int = NEVER) -> bool:
        """Whether merging the bytes of ``a`` and ``b`` gives these two tokens.

        Follows the merges of both sides in the order of their ranks; of two merges with one rank
        the left one goes first. A merge across the border that comes before the next merge of its
        neighbours would destroy them. Only merges before rank ``until`` count.
        """
        left, right = self._spine(a)[0], self._spine(b)[1]
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            joins = self.rank.get((x, y))
            if joins is not None and joins < x_ends and joins <= y_ends and joins < until:
                return False
            if x_ends == y_ends == NEVER:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def encode_piece(self, raw: bytes) -> tuple[int, ...]:
        """Ids of one pre-token."""
        if not raw:
            return ()
        last = [-1] * len(raw)
        size = [0] * len(raw)
        fits = self._fits
        for end, (token, length) in self.matcher.iter(raw.decode("latin-1")):
            if last[end] >= 0:
                continue
            start = end - length
            if start >= 0:
                pair = last[start] << 20 | token
                good = fits.get(pair)
                if good is None:
                    if len(fits) >= 400_000:
                        fits.clear()
                    good = fits[pair] = self.compatible(last[start], token)
                if not good:
                    continue
            last[end], size[end] = token, length
        ids = []
        at = len(raw) - 1
        while at >= 0:
            ids.append(last[at])
            at -= size[at]
        return tuple(reversed(ids))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; special tokens in it get their own ids."""
        if not text:
            return []
        if self._split and self._split.search(text):
            ids, at = [], 0
            for m in self._split.finditer(text):
                ids += self._plain(text[at : m.start()])
                ids.append(self.special[m.group()])
                at = m.end()
            return ids + self._plain(text[at:])
        return self._plain(text)

    def _plain(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, self._pieces.findall(text))))

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def coder(path: str) -> PrefixBpe:
    """One coder per Python worker, kept from task to task."""
    return PrefixBpe(path)


def encode_texts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids of every row; a null or empty text has no ids, an empty table no rows.

    Repeated and missing doc_ids are rows of their own, and other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                piece = batch.slice(low, 1000)
                ids = [bpe.encode(t) for t in piece.column(1).to_pylist()]
                yield pa.record_batch(
                    [piece.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"]
                )

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return plain.mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows of (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            texts = [bpe.decode(i or []) for i in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def coding_digest(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, encoded and decoded in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        names = {i: str(i) for i in bpe.bytes_of}
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for t in batch.column(1).to_pylist():
                ids = bpe.encode(t)
                counts.append(len(ids))
                ids_sha.append(sha(",".join(map(names.__getitem__, ids)).encode()))
                text_sha.append(sha(bpe.decode(ids).encode()))
            yield pa.record_batch(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()),
                 pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return plain.mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
