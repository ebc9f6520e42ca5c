"""The sentencepiece form of a rank vocabulary against the tiktoken library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql.types import BinaryType

import __spark_entry__ as entry
from shipsight.llm import piece_bpe
from tests.llm.test_operators import LONG, SF, TEXTS

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    return piece_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 0.5, "y") for i, t in TEXTS], "doc_id long, text string, ids string, score double, decoded string").repartition(3)


def test_ids_and_bytes_are_those_of_the_library(docs, ranks, library):
    want = sorted((i, library.encode_ordinary(t or ""), t or "") for i, t in TEXTS)
    for packed in (False, True):
        rows = piece_bpe.decode(piece_bpe.encode(docs, ranks, PATTERN, packed=packed), ranks)
        assert sorted(rows.columns) == sorted(docs.columns)
        got = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist() if packed else r.ids, bytes(r.decoded).decode()) for r in rows.collect()]
        assert sorted(got) == want


def test_empty_table_and_null_ids(spark, docs, ranks):
    none = piece_bpe.decode(piece_bpe.encode(docs.limit(0), ranks, PATTERN), ranks)
    assert none.count() == 0
    assert none.schema["decoded"].dataType == BinaryType()
    rows = piece_bpe.decode(spark.createDataFrame([(None,), ([],), ([1, 2],)], "ids array<int>"), ranks).collect()
    by_rank = {i: raw for raw, i in ranks.items()}
    assert sorted(bytes(r.decoded) for r in rows) == sorted([b"", b"", by_rank[1] + by_rank[2]])


def test_random_words_of_many_scripts(ranks, library):
    rng = random.Random(5)
    letters = "aeinrst  .,'\n\t0159éßñЖдю東京語한국어😀 \x1c​́"
    bodies = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(500)] + ["a" * 5000, " " * 3000, LONG]
    encoder = piece_bpe.Encoder(piece_bpe.serialised(ranks), np.array(sorted(ranks.values()), np.int32), PATTERN)
    for _ in range(2):  # the second time from memory
        assert [np.frombuffer(x, np.int32).tolist() for x in encoder.encode(bodies)] == library.encode_ordinary_batch(bodies)


def test_a_token_that_merging_does_not_give(spark):
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"abcd": 400}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(1, "abcd"), (2, "abcd abcdabcd ab")]
    got = piece_bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), ranks, PATTERN).collect()
    assert {r.doc_id: r.ids for r in got} == {i: library.encode_ordinary(t) for i, t in rows}


def test_a_missing_byte_is_an_error():
    with pytest.raises(ValueError):
        piece_bpe.serialised({b"a": 0})


def test_query_over_all_documents(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {tuple(r) for r in entry.queries()["op13_piece_bpe"](spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    ids = {i: library.encode_ordinary(t) for i, t in docs.items()}
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    assert got == {(i, len(x), sha(np.array(x, "<u4").tobytes()), sha(docs[i].encode())) for i, x in ids.items()}
