"""Encoding of a whole corpus with a public byte-level BPE tokenizer, word by distinct word.

Spark splits every text once into the words that the tokenizer's own pattern gives. A word that
is a piece of the vocabulary is its own encoding; each other distinct word of the corpus is
encoded once into a table (word, ids), and ids are joined back by position. The most frequent
words of that table, a bounded number of bounded length, travel to the workers as a dictionary,
so only rare words meet the table in a shuffle join. Decoding goes the other way through a join
with the table of ids and their pieces.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.session import cut, ship, spread

#: Where the public vocabularies lie; a parameter, never a copy.
TOKENIZERS = os.environ.get("TALLYFORGE_TOKENIZERS", "/opt/tokenizers")
RANKS = "byte_bpe_50k.tiktoken"

#: The tokenizer's split pattern in Java's dialect, the commonest words first: white space spelled out, as Java's \s is ASCII only.
_S = r"\t\n\x0B\f\r \x85\xA0  -     　"
WORD_PATTERN = rf" ?\p{{L}}++|'(?:s|t|re|ve|m|ll|d)| ?(?:\p{{N}}++|[^{_S}\p{{L}}\p{{N}}]++)|[{_S}]+(?![^{_S}])|[{_S}]++"
#: The same for Python's regex library, whose tables are newer than Java's.
_PY_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The dictionary that travels: so many words, none longer than so many bytes.
HOT_WORDS = 1 << 15
HOT_BYTES = 256


@lru_cache(maxsize=4)
def ranks(folder: str, name: str = RANKS) -> dict[bytes, int]:
    with open(os.path.join(folder, name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoder(folder: str, name: str = RANKS):
    import tiktoken

    return tiktoken.Encoding(name, pat_str=_PY_PATTERN, mergeable_ranks=ranks(folder, name), special_tokens={})


@lru_cache(maxsize=4)
def _splitter(folder: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(os.path.join(folder, "byte_bpe_50k.json")).pre_tokenizer


def _newer(text: Column) -> Column:
    """Whether a text has characters newer than Java's tables, so that the tokenizer itself must split it."""
    return F.coalesce(text.rlike(r"\p{Cn}"), F.lit(False))


def _by_java(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0)), F.array().cast("array<string>"))


def _by_tokenizer(text: str, folder: str) -> list[str]:
    return [text[a:b] for _, (a, b) in _splitter(folder).pre_tokenize_str(text)]


def words(text: Column, folder: str = TOKENIZERS) -> Column:
    """The words of a text in order; their concatenation is the text. None for null and empty texts.

    Java splits; a text with characters newer than Java's tables is split by the tokenizer itself.
    """
    split = F.pandas_udf(lambda texts: texts.map(lambda t: None if t is None else _by_tokenizer(t, folder)), "array<string>")
    return F.when(_newer(text), split(F.when(_newer(text), text))).otherwise(_by_java(text))


@lru_cache(maxsize=4)
def _whole_pieces(folder: str) -> tuple[pa.Array, np.ndarray]:
    """The words that are pieces of the vocabulary, and their ids; a fixed size."""
    enc = encoder(folder)
    found = []
    for piece in ranks(folder):
        try:
            word = piece.decode("utf-8")
        except UnicodeDecodeError:
            continue
        ids = enc.encode_ordinary(word)
        if len(ids) == 1:
            found.append((word, ids[0]))
    return pa.array([w for w, _ in found], pa.string()), np.array([i for _, i in found], np.int32)


def _split(folder: str):
    """Rows of words into rows of ids, -1 where a word is no piece, and those words in order."""

    def look_up(b: pa.RecordBatch, lists: pa.Array) -> pa.RecordBatch:
        known, ids = _whole_pieces(folder)
        flat = lists.flatten().cast(pa.string())
        upto = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        at = pc.fill_null(pc.index_in(flat, value_set=known), len(known)).to_numpy(zero_copy_only=False)
        cold = np.flatnonzero(at == len(known))
        offsets = lambda x: pa.array(x.astype(np.int32))
        found = [pa.ListArray.from_arrays(offsets(upto), pa.array(np.append(ids, np.int32(-1))[at])), pa.ListArray.from_arrays(offsets(np.searchsorted(cold, upto)), flat.take(pa.array(cold)))]
        return pa.RecordBatch.from_arrays([b.column("row_no"), b.column("doc_id"), *found], names=["row_no", "doc_id", "ids", "cold"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            newer = pc.is_valid(b.column("newer"))
            if pc.any(newer).as_py():
                rest = b.filter(newer)
                yield look_up(rest, pa.array([_by_tokenizer(t, folder) for t in rest.column("newer").to_pylist()], pa.list_(pa.string())))
                b = b.filter(pc.invert(newer))
            yield look_up(b, b.column("words"))

    return run


def word_table(split: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """Every distinct word that is no piece, how often it occurs, and its ids, encoded once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder)
        for b in batches:
            ids = [enc.encode_ordinary(w) for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(ids, pa.list_(pa.int32()))], names=["word", "n", "ids"])

    counted = split.select(F.explode("cold").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.mapInArrow(encode, "word string, n bigint, ids array<int>")


def _hot(table: DataFrame, spark: SparkSession):
    """The most frequent short words and their ids, as a broadcast; at most HOT_WORDS rows of bounded length."""
    top = table.where(F.octet_length("word") <= HOT_BYTES).orderBy(F.desc("n"), "word").limit(HOT_WORDS).select("word", "ids").collect()
    lens = np.array([len(r.ids) for r in top], np.int64)
    vals = np.array([i for r in top for i in r.ids], np.int32)
    return spark.sparkContext.broadcast(([r.word for r in top], lens, vals))


def _segments(hot):
    """Split rows into rows of ids: one a run of known words, one a word that is neither piece nor hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lens, vals = hot.value
        lens = np.append(lens, 0)  # a word that isn't known adds no ids here
        starts = np.concatenate([[0], np.cumsum(lens)])[:-1]
        known = pa.array(known, pa.string())
        for b in batches:
            lists = b.column("ids")
            own = lists.flatten().to_numpy(zero_copy_only=False)
            flat = b.column("cold").flatten()
            n_words = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(len(lists)), n_words)
            # a piece's id lies behind the hot words' ids, at the word's own place
            n, begin = np.ones(len(doc), np.int64), len(vals) + np.arange(len(doc))
            asked = np.flatnonzero(own < 0)
            at = pc.fill_null(pc.index_in(flat, value_set=known), len(known)).to_numpy(zero_copy_only=False).astype(np.int64)
            n[asked], begin[asked] = lens[at], starts[at]
            cold = np.zeros(len(doc), bool)
            cold[asked[at == len(known)]] = True
            nth = np.cumsum(own < 0) - 1  # of the asked words, for the cold ones
            first = np.ones(len(doc), bool)
            first[1:] = (doc[1:] != doc[:-1]) | cold[1:] | cold[:-1]
            head = np.flatnonzero(first)
            upto = np.concatenate([[0], np.cumsum(n)])
            src = np.repeat(begin - upto[:-1], n) + np.arange(upto[-1])
            ids = np.concatenate([vals, own])[src].astype(np.int32)
            whole = np.bincount(doc[cold], minlength=len(lists)) == 0
            # a text without words still has a row
            none = np.flatnonzero(n_words == 0)
            offsets = np.concatenate([upto[head], [upto[-1]] * (len(none) + 1)]).astype(np.int32)
            owner = np.concatenate([doc[head], none])
            pos = np.concatenate([head, np.zeros(len(none), np.int64)])
            word = pa.array(np.concatenate([np.where(cold[head], nth[head], 0), np.zeros(len(none), np.int64)]), mask=np.concatenate([~cold[head], np.ones(len(none), bool)]))
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [b.column("row_no").take(take), b.column("doc_id").take(take), pa.array(pos), flat.take(word), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32())), pa.array(whole[owner])],
                names=["row_no", "doc_id", "pos", "word", "ids", "whole"],
            )

    return run


#: Rows of one long word beyond which the join with it is spread over several keys.
ROWS_PER_SALT = 100_000


def _joined(rare: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of words with their ids. Frequent words too long for the dictionary are salted.

    Their list is short, as a word on it has more than ``ROWS_PER_SALT`` rows, and holds hashes
    instead of words; words that share a hash are salted alike.
    """
    key = F.xxhash64("word")
    long = table.where((F.octet_length("word") > HOT_BYTES) & (F.col("n") > ROWS_PER_SALT))
    salts = long.groupBy(key.alias("h")).agg(F.ceil(F.max("n") / ROWS_PER_SALT).cast("int").alias("salts"))
    salts = cut(salts, "long-words")
    if salts.isEmpty():
        return rare.join(table.select("word", "ids"), "word").select("row_no", "doc_id", "pos", "ids")
    spread_rows = rare.withColumn("h", key).join(salts, "h", "left").withColumn("salt", F.pmod(F.xxhash64("row_no", "pos"), F.coalesce("salts", F.lit(1))).cast("int"))
    copies = table.select("word", "ids", key.alias("h")).join(salts, "h", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    return spread_rows.join(copies.select("word", "salt", F.col("ids")), ["word", "salt"]).select("row_no", "doc_id", "pos", "ids")


def encode_corpus(docs: DataFrame, doc_id: str, text: str, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids): the token ids of every row's text, taken exactly as stored, without special tokens.

    Null and empty texts have an empty list. One row comes out for every row that goes in, repeated
    and null ids included; other columns are left out, so none can clash. Strings of special
    tokens in a text are ordinary text. A text of any length is one row. Every text is split
    once; the split texts, the word table and the ids of known words are written to the shared
    folder, so a lost executor costs no rework beyond its own tasks.
    """
    spark = docs.sparkSession
    ship(spark)
    src = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    kind = dict(src.dtypes)["doc_id"]
    body = F.col("text")
    rows = src.select(F.monotonically_increasing_id().alias("row_no"), "doc_id", _newer(body).alias("is_newer"), "text")
    rows = rows.select("row_no", "doc_id", F.when(F.col("is_newer"), body).alias("newer"), F.when(~F.col("is_newer"), _by_java(body)).alias("words"))
    # row numbers are fixed once the table is written
    split = cut(rows.mapInArrow(_split(folder), f"row_no bigint, doc_id {kind}, ids array<int>, cold array<string>"), "split")
    table = cut(word_table(split, folder), "words")
    hot = _hot(table, spark)
    done = cut(spread(split).mapInArrow(_segments(hot), f"row_no bigint, doc_id {kind}, pos bigint, word string, ids array<int>, whole boolean"), "segments")
    rest = done.where(~F.col("whole"))
    rare = _joined(rest.where(F.col("word").isNotNull()).select("row_no", "doc_id", "pos", "word"), table)
    parts = rest.where(F.col("word").isNull()).select("row_no", "doc_id", "pos", "ids").unionByName(rare)
    joined = parts.groupBy("row_no", "doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("parts"))
    joined = joined.select("doc_id", F.flatten(F.col("parts.ids")).alias("ids"))
    out = done.where("whole").select("doc_id", "ids").unionByName(joined)
    return out.withColumnRenamed("doc_id", doc_id)


@lru_cache(maxsize=4)
def piece_table(folder: str, name: str = RANKS) -> pa.Array:
    """The bytes of every token id by position, and no bytes at the end for ids that don't exist; a fixed size."""
    by_id = {i: b for b, i in ranks(folder, name).items()}
    return pa.array([by_id.get(i, b"") for i in range(max(by_id) + 2)], pa.binary())


#: Bytes of text beyond which a batch is decoded in halves.
_BATCH_BYTES = 1 << 30


def _decode_batch(batch: pa.RecordBatch, pieces: pa.Array) -> Iterator[pa.RecordBatch]:
    lists = batch.column("ids")
    flat = lists.flatten()
    none = len(pieces) - 1
    known = pc.fill_null(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, none)), False)
    joined = pieces.take(pc.if_else(known, flat, none))
    upto = np.concatenate([[0], np.cumsum(pc.binary_length(joined).to_numpy(zero_copy_only=False).astype(np.int64))])
    if upto[-1] > _BATCH_BYTES and batch.num_rows > 1:
        half = batch.num_rows // 2
        yield from _decode_batch(batch.slice(0, half), pieces)
        yield from _decode_batch(batch.slice(half), pieces)
        return
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
    # pieces taken in order lie one behind the other: the texts are slices of their bytes
    data = joined.buffers()[2] if len(joined) and joined.buffers()[2] is not None else pa.py_buffer(b"")
    text = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(upto[ends].astype(np.int32)), data])
    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text], names=["doc_id", "text"])


def decode_corpus(encoded: DataFrame, doc_id: str, ids: str, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, text): the texts that lists of ids stand for; an empty or null list is an empty text.

    One row a row; ids that the vocabulary doesn't have, and null ones, add nothing, and bytes that
    are no UTF-8 become U+FFFD. The ids of a batch are joined with the pieces by position, as the
    vocabulary is a table of fixed size; rows stay where they are, without explode or shuffle.
    """
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _decode_batch(b, piece_table(folder))

    rows = encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    text = rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text binary")
    return text.select(F.col("doc_id").alias(doc_id), F.make_valid_utf8(F.col("text").cast("string")).alias("text"))
