import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rinkspark.llm.bpe import Bpe
from rinkspark.llm.token_counts import count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "   ", " a  b\t\n c", "aaaaaaaaaaaaaaaa", "x²½Ⅷ3", "<|endoftext|>a<|endoftext|>", "日本語ab\x1c x", "é" * 50, "\x85\xa0 q",
       "'s'll 'don't", "a" * 3000 + " " * 2000, "_a_ _1_ ١٢ "]


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(PATH)
    return lambda text: made.encode(text, add_special_tokens=False).ids


def texts():
    draw = random.Random(3)
    return ODD + ["".join(draw.choices(" \n\tabé'1²_.日\x1c　ll", k=200)) for _ in range(60)]


@pytest.mark.parametrize("cache,window", [(300_000, 1 << 20), (40, 7)])
def test_ids_equal_the_library(library, cache, window):
    bpe = Bpe(PATH, cache=cache, window=window)
    for text in texts():
        want = library(text)
        got = bpe.ids_of([text])[0]
        assert [int.from_bytes(got[k : k + 4], "little") for k in range(0, len(got), 4)] == want
        assert bpe.counts_of([text]) == [len(want)]


def test_counts_with_nulls_copies_and_clashing_columns(spark, library):
    rows = [(k, t, 7) for k, t in enumerate(texts())] + [(None, "a b", 1), (3, None, 2), (4, "a b", 1), (4, "a b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    got = sorted(map(tuple, count_tokens(docs, PATH, limit=5).collect()), key=str)
    want = [(i, len((t or "").encode()), len(library(t or "")), len(library(t or "")) > 5) for i, t, _ in rows]
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
