"""Packing, token files and byte-pair coding against the tokenizers library."""

import hashlib
import random
import zlib
from array import array
from collections import Counter

import pyarrow.orc as orc
import pytest
from helpers import FOLDER, empty_frame, odd_frame, odd_rows, texts

from corpuslab.llm import packing, prefix_bpe, token_files
from corpuslab.llm.common import (
    BYTE_BPE,
    WORD_BPE,
    ChunkEncoder,
    byte_letters,
    library_tokenizer,
    tokenizer_path,
)
from corpuslab.llm.queries import QUERIES
from corpuslab.staging import work_path

ALPHABET = "ab \n\t\x1c\x85 éÉßñ'sСΣ中\U0001f600é12.,-<|the ThİK"


def random_texts(n, seed):
    draw = random.Random(seed)
    for k in range(n):
        text = "".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 30)))
        yield text + "<|endoftext|>" + text if k % 9 == 0 else text


def ids_of(file, text):
    return library_tokenizer(tokenizer_path(file)).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(array("I", ids).tobytes())


def test_chunk_encoder_equals_library():
    encoder = ChunkEncoder(tokenizer_path(WORD_BPE), limit=50)
    for text in [*random_texts(4000, 1), *texts().values()]:
        assert encoder(text) == array("I", ids_of(WORD_BPE, text)).tobytes()


def test_chunk_encoder_refuses_other_tokenizers():
    with pytest.raises(ValueError):
        ChunkEncoder(tokenizer_path(BYTE_BPE))


def test_prefix_bpe_equals_library():
    bpe = prefix_bpe.PrefixBpe(tokenizer_path(BYTE_BPE), limit=50)
    library = library_tokenizer(tokenizer_path(BYTE_BPE))
    for text in [*random_texts(4000, 2), *texts().values()]:
        ids = ids_of(BYTE_BPE, text)
        assert bpe.encode(text) == ids
        assert bpe.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_prefix_bpe_on_joined_tokens():
    bpe = prefix_bpe.PrefixBpe(tokenizer_path(BYTE_BPE))
    library = library_tokenizer(tokenizer_path(BYTE_BPE))
    draw = random.Random(3)
    vocabulary = [b for i, b in bpe.bytes_of.items() if i not in bpe.special.values()]
    letters = byte_letters()
    for _ in range(3000):
        raw = b"".join(draw.sample(vocabulary, draw.randint(1, 4)))
        expected = [t.id for t in library.model.tokenize("".join(letters[b] for b in raw))]
        assert list(bpe.encode_piece(raw)) == expected
        assert bpe.decode([i for i in expected]) == raw.decode("utf-8", "replace")


def test_coding_query(spark):
    found = {r["doc_id"]: r for r in QUERIES["op4_prefix_bpe"](spark, FOLDER).collect()}
    for doc_id, text in texts().items():
        ids = ids_of(BYTE_BPE, text)
        assert found[doc_id]["n_tokens"] == len(ids)
        assert found[doc_id]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[doc_id]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_coding_odd_rows(spark):
    path = tokenizer_path(BYTE_BPE)
    encoded = prefix_bpe.encode_texts(odd_frame(spark), path)
    decoded = prefix_bpe.decode_ids(encoded, path)
    expected = sorted((str(r[0]), r[1] or "") for r in odd_rows())
    assert sorted((str(r["doc_id"]), r["text"]) for r in decoded.collect()) == expected
    assert prefix_bpe.coding_digest(empty_frame(spark), path).count() == 0


def test_token_files_query(spark):
    rows = QUERIES["op3_token_files"](spark, FOLDER).collect()
    start = 0
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts())
    for doc_id, text in sorted(texts().items()):
        ids = [*ids_of(WORD_BPE, text), 1]
        row = by_id[doc_id]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)


def test_token_files_format(spark):
    path = work_path(spark, "test-tokens")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    token_files.write_tokens(docs, path, tokenizer_path(WORD_BPE))
    files = sorted(f for f in spark.sparkContext.wholeTextFiles(path + "/*.orc").keys().collect())
    last = -1
    for file in files:
        table = orc.ORCFile(file.removeprefix("file:")).read().to_pydict()
        assert table["doc_id"] == sorted(table["doc_id"]) and table["doc_id"][0] > last
        last = table["doc_id"][-1]
    some = token_files.read_tokens(spark, path, [7, 150])
    assert sorted(r["doc_id"] for r in some.collect()) == [7, 150]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id, [150,7])]" in plan or "In(doc_id, [7,150])" in plan
    ids = {r["doc_id"]: r["ids"] for r in some.collect()}
    assert ids[7] == [*ids_of(WORD_BPE, texts()[7]), 1]


def test_token_files_odd_rows(spark):
    path = work_path(spark, "odd-tokens")
    token_files.write_tokens(odd_frame(spark), path, tokenizer_path(WORD_BPE))
    rows = sorted(token_files.token_digest(spark, path).collect(), key=lambda r: r["start"])
    order = [r["doc_id"] for r in rows]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    start = 0
    for r in rows:
        assert r["start"] == start
        start += r["n_tokens"]
    expected = Counter((r[0], crc([*ids_of(WORD_BPE, r[1]), 1])) for r in odd_rows())
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in rows) == expected
    path = work_path(spark, "no-tokens")
    token_files.write_tokens(empty_frame(spark), path, tokenizer_path(WORD_BPE))
    assert token_files.token_digest(spark, path).count() == 0


def check_packing(rows, capacity):
    """Every sequence is gapless from 0 and not too long; gives the number of sequences."""
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing_query(spark):
    rows = QUERIES["op1_best_fit_packing"](spark, FOLDER).collect()
    expected = Counter()
    total = 0
    for doc_id, text in texts().items():
        ids = [*ids_of(WORD_BPE, text), 1]
        total += len(ids)
        for piece, start in enumerate(range(0, len(ids), 4096)):
            bit = ids[start : start + 4096]
            expected[doc_id, piece, start, len(bit), crc(bit)] += 1
    assert Counter((r[0], r[1], r[2], r[3], r[4]) for r in rows) == expected
    assert check_packing(rows, 4096) <= -(-total // 4096) + 1


def test_packing_odd_rows(spark):
    rows = packing.pack(odd_frame(spark), tokenizer_path(WORD_BPE), capacity=64, rounds=4).collect()
    total = sum(len(ids_of(WORD_BPE, r[1])) + 1 for r in odd_rows())
    assert sum(r["length"] for r in rows) == total
    assert check_packing(rows, 64) <= -(-total // 64) + 1
    assert packing.pack(empty_frame(spark), tokenizer_path(WORD_BPE)).count() == 0


@pytest.mark.parametrize("counts", [{3: 7}, {6: 5, 4: 5}, {10: 1}, {7: 40, 5: 33, 3: 12, 1: 2}, {9: 3, 2: 1}])
def test_plan_uses_few_sequences(counts):
    plan = packing.packing_plan(counts, capacity=10, rounds=6)
    used = {}
    for length, rank, each, first, offset in plan.tolist():
        number = next((r[1] for r in plan.tolist() if r[0] == length and r[1] > rank), counts[length]) - rank
        for s in range(number // each):
            used.setdefault(first + s, []).extend([(offset + k * length, length) for k in range(each)])
    assert sum(len(v) for v in used.values()) == sum(counts.values())
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 10
    # Lengths over a half need a sequence each, two halves fill one.
    volume = -(-sum(n * k for n, k in counts.items()) // 10)
    halves = sum(k for n, k in counts.items() if n > 5) - (-counts.get(5, 0) // 2)
    assert len(used) <= max(volume, halves) + 1


def test_pricing_is_optimal():
    import itertools

    import numpy as np

    draw = random.Random(5)
    values = np.full(13, -1.0)
    for n in (2, 3, 5, 7):
        values[n] = draw.random()
    best, last = packing.price(values)
    every = max(
        sum(k * values[n] for n, k in zip((2, 3, 5, 7), ks))
        for ks in itertools.product(range(7), range(5), range(3), range(2))
        if sum(n * k for n, k in zip((2, 3, 5, 7), ks)) <= 12
    )
    assert abs(best[12] - every) < 1e-9
    column = packing.column_with(5, last)
    assert sum(n * k for n, k in column) <= 12 and dict(column)[5] >= 1


def histograms():
    """Lengths as documents have them, even ones, pieces of a third to three quarters, a few lengths."""
    import numpy as np

    draw = np.random.default_rng(1)
    mixed = [draw.integers(2000, 2100, 10000), draw.integers(1000, 1100, 20000), draw.lognormal(4, 1, 50000)]
    return {
        "log-normal": draw.lognormal(5.5, 1.2, 100_000),
        "even": draw.integers(1, 4097, 40_000),
        "large": draw.integers(1300, 3000, 40_000),
        "mixed": np.concatenate(mixed),
        "few": draw.choice([1500, 1400, 1300, 700, 2500], 30_000),
    }


@pytest.mark.parametrize("name", ["log-normal", "even", "large", "mixed", "few"])
def test_cover_is_near_its_bound_and_plan_near_the_cover(name):
    """The program is solved: bound <= cover <= plan, and the plan is hardly larger."""
    lengths = [min(max(int(n), 1), 4096) for n in histograms()[name]]
    counts = dict(Counter(lengths))
    cover, bound = packing.fractional_columns(counts)
    covered = Counter()
    for column, amount in cover.items():
        assert sum(n * k for n, k in column) <= 4096 and amount > 0
        for n, k in column:
            covered[n] += k * amount
    assert all(covered[n] >= counts[n] - 1e-6 for n in counts)
    value = sum(cover.values())
    plan = sum(number for _, number in packing.sequences_of(counts, 4096, packing.ROUNDS))
    alone = sum(number for _, number in packing.best_fit([], dict(counts), 4096))
    assert bound <= value + 1e-6 and value <= plan * 1.001 and plan <= alone
    # Between five lengths, whole numbers of pieces keep the bound of the prices away.
    assert value <= bound * (1.03 if name == "few" else 1.01)
    assert plan <= value * 1.002 + 1
