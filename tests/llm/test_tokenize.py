import os

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import tokenize
from tallyforge.llm.tokenize import TOKENIZERS, decode_corpus, encode_corpus, words

pytestmark = pytest.mark.skipif(not os.path.isdir(TOKENIZERS), reason="the vocabularies are not here")

TEXTS = [
    None, "", " ", "   \n\n  x", "hello world", "it's they'll I'D 'S", "tabs\t\tand\r\nlines", "日本語の文章、2024年。", "½ ２ Ⅷ ³", "naïve façade", "👩‍💻🇯🇵 📎", "​zero nbsp　wide", "<|endoftext|> is text", "a\u0000b",
    "xࡰࡱ ࡲ new letters \U0001e4d0 \U000323b0", "あ" * 30_000, "word " * 20_000, "x" * 50_000, *["a" + "xyz" * 100 + f" {i} zzqj" for i in range(5)], "1" * 3_000, "!?" * 2_000, " lead", "trail ", "﻿BOM",
]


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(os.path.join(TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


@pytest.fixture
def docs(spark):
    data = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(4, "hello world", "again"), (None, "no id", "x")]
    return spark.createDataFrame(data, "doc_id bigint, text string, row_no string").withColumn("ids", F.lit(1)).repartition(3)


@pytest.mark.parametrize(("hot", "salt"), [(0, 2), (3, 100_000), (tokenize.HOT_WORDS, 1)])
def test_ids_are_the_tokenizers(spark, docs, reference, monkeypatch, hot, salt):
    monkeypatch.setattr(tokenize, "HOT_WORDS", hot)
    monkeypatch.setattr(tokenize, "ROWS_PER_SALT", salt)  # long words that occur more often are salted
    got = sorted(((r.doc_id, list(r.ids)) for r in encode_corpus(docs, "doc_id", "text").collect()), key=str)
    want = sorted([(i, reference(t)) for i, t in enumerate(TEXTS)] + [(4, reference("hello world")), (None, reference("no id"))], key=str)
    assert got == want


def test_round_trip(spark, docs):
    back = decode_corpus(encode_corpus(docs, "doc_id", "text"), "doc_id", "ids")
    want = sorted([(i, t or "") for i, t in enumerate(TEXTS)] + [(4, "hello world"), (None, "no id")], key=str)
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == want


def test_strange_ids(spark):
    df = spark.createDataFrame([(1, [99_999_999, 31373]), (2, None), (3, []), (4, [None, 31373])], "doc_id int, ids array<int>")
    got = {r.doc_id: r.text for r in decode_corpus(df, "doc_id", "ids").collect()}
    assert got == {1: "hello", 2: "", 3: "", 4: "hello"}


def test_empty_table_and_words(spark, docs):
    assert encode_corpus(docs.limit(0), "doc_id", "text").count() == 0
    bad = docs.where(F.col("text").isNotNull() & (F.array_join(words(F.col("text")), "") != F.col("text")))
    assert bad.count() == 0
