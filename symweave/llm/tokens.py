"""Encoding of the whole corpus with a public tokenizer (problem 6).

The texts are split into words by a regular expression inside Spark, each distinct word of the corpus is encoded once
into a word table, and the ids come back by position. The most frequent words are broadcast, as many as fit a bound;
a word beyond it is in fewer texts than all of them, so none is hot, and its ids come through a shuffled join. Words
longer than WORD_BYTES (rules, white space, encoded data) are in no table and are encoded where they stand.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symweave.session import cut

#: Folder of the vocabulary files.
FOLDER = "/opt/tokenizers"
#: Words that are broadcast at most, and the longest words of the table in bytes.
HEAD_WORDS, WORD_BYTES = 1_000_000, 128
#: Byte-level tokenizers, which never merge across words.
WORD_LEVEL = ("byte_bpe_50k", "byte_bpe_multi_50k")
# The published word pattern of the byte-level vocabularies, for the library and, with Unicode white space, for Spark.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPARK_PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"


def words(text: str) -> F.Column:
    """The words of a text in order; none for null.

    A text with code points that the Java runtime doesn't know is one word, so that the library's own Unicode tables
    split it.
    """
    whole = F.when(F.col(text).rlike(r"\p{Cn}"), F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(SPARK_PATTERN), F.lit(0)))
    return F.coalesce(whole, F.array().cast("array<string>"))


@functools.cache
def encoder(name: str, folder: str = FOLDER):
    """A function from a list of texts to their lists of ids, without special tokens; loaded once in each worker."""
    if name in WORD_LEVEL:
        import tiktoken

        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        one = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda texts: [one(t) for t in texts]
    if name == "piece_bpe_32k":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, f"{name}.model"))
        return lambda texts: model.encode(texts, num_threads=1)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(os.path.join(folder, f"{name}.json"))
    library.encode_special_tokens = True
    return lambda texts: [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def word_table(docs: DataFrame, name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(word, n_docs, ids): each distinct word of docs.text of up to WORD_BYTES, with the number of texts that hold it and its ids."""
    counted = docs.select(F.explode(F.array_distinct(words("text"))).alias("word")).where(F.octet_length("word") <= WORD_BYTES).groupBy("word").agg(F.count(F.lit(1)).alias("n_docs"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(ids=encoder(name, folder)(b["word"].tolist()))

    return counted.mapInPandas(encode, "word string, n_docs bigint, ids array<int>")


def _rarity() -> F.Column:
    """Words by the binary order of magnitude of their texts, in eighths: some hundred steps, however many words there are."""
    return F.floor(8 * F.log2("n_docs")).cast("int")


def head_words(table: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The most frequent words, no more than so many, and whether that is all of the table.

    A histogram of the steps of _rarity gives the least frequency that is still broadcast, so nothing is sorted.
    """
    steps = sorted(((r.step, r["count"]) for r in table.groupBy(_rarity().alias("step")).count().collect()), reverse=True)
    kept, least = 0, None
    for step, n in steps:
        if kept + n > most:
            break
        kept, least = kept + n, step
    return table.where(_rarity() >= least) if least is not None else table.limit(0), kept == sum(n for _, n in steps)


def _gather(starts: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The pieces flat[start : start + length], one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


def _list_parts(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The values of all lists in a row, and the offsets of each list; null lists are empty."""
    offsets = column.offsets.to_numpy()
    return column.values.slice(offsets[0], offsets[-1] - offsets[0]) if len(offsets) else column.values, offsets - offsets[0]


def encode_corpus(docs: DataFrame, name: str = "byte_bpe_50k", folder: str = FOLDER, head: int = HEAD_WORDS) -> DataFrame:
    """(doc_id, ids) for each row of docs, ids of a word-level tokenizer without special tokens.

    Null and empty texts have an empty list; strings of special tokens within a text are ordinary text; texts of any
    length are encoded whole; repeated rows come out as often as they are there. Other columns of docs are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    table = cut(word_table(docs, name, folder))
    frequent, all_known = head_words(table, head)
    known = spark.sparkContext.broadcast(_pack_table(frequent))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, starts, lengths, flat = _unpack_table(known.value)
        for b in batches:
            values, offsets = _list_parts(b.column("words"))
            coded = values.dictionary_encode()
            distinct = pc.fill_null(pc.index_in(coded.dictionary, value_set=vocabulary), len(vocabulary)).to_numpy().astype(np.int64)
            own_starts, own_lengths, own_flat = starts, lengths, flat
            # The unknown word's id -1 stays in its place until the join brings its ids; long words get theirs here.
            long = np.flatnonzero(pc.greater(pc.binary_length(coded.dictionary), WORD_BYTES).to_numpy(zero_copy_only=False))
            if len(long):
                pieces = [np.array(i, np.int32) for i in encoder(name, folder)(coded.dictionary.take(pa.array(long)).to_pylist())]
                own_lengths = np.concatenate((lengths, [len(i) for i in pieces]))
                own_starts = np.concatenate((starts, len(flat) + np.cumsum([0] + [len(i) for i in pieces])[:-1]))
                own_flat = np.concatenate((flat, *pieces))
                distinct[long] = len(lengths) + np.arange(len(long))
            at = distinct[coded.indices.to_numpy()]
            ends = np.concatenate(([0], np.cumsum(own_lengths[at])))[offsets]
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_gather(own_starts[at], own_lengths[at], own_flat), pa.int32()))
            missing = np.flatnonzero(at == len(vocabulary))
            rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(missing, offsets), pa.int32()), values.take(pa.array(missing)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids, rare], ["doc_id", "ids", "rare"])

    coded = docs.select("doc_id", words("text").alias("words")).mapInArrow(gather, "doc_id bigint, ids array<int>, rare array<string>")
    if all_known:
        return coded.drop("rare")
    coded = cut(coded.withColumn("row", F.monotonically_increasing_id()))
    wanted = coded.select("row", F.posexplode("rare").alias("at", "word"))
    found = wanted.join(table.select("word", F.col("ids").alias("piece")), "word")
    fills = found.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x.piece).alias("fills"))
    gaps = F.transform(F.filter(F.transform("ids", lambda x, i: F.struct(x.alias("id"), i.alias("i"))), lambda x: x.id == -1), lambda x: x.i)
    filled = coded.where("size(rare) > 0").select("row", "doc_id", "ids", gaps.alias("gaps")).join(fills, "row")
    # Each stretch between two gaps, and after each gap the ids that belong into it.
    parts = F.transform(
        F.arrays_zip(F.concat(F.array(F.lit(-1)), "gaps").alias("a"), F.concat("gaps", F.array(F.size("ids"))).alias("b"), F.concat("fills", F.array(F.array().cast("array<int>"))).alias("f")),
        lambda z: F.concat(F.slice("ids", z.a + 2, z.b - z.a - 1), z.f),
    )
    return coded.where("size(rare) = 0").select("doc_id", "ids").unionByName(filled.select("doc_id", F.flatten(parts).alias("ids")))


def _pack_table(head: DataFrame) -> bytes:
    """The bounded word table as one Arrow buffer."""
    rows = head.select("word", "ids").toArrow().combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpack_table(packed: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Words, and the start, length and flat ids of each, with one more entry that stands for an unknown word."""
    rows = pa.ipc.open_stream(packed).read_all().combine_chunks()
    word = rows.column("word").combine_chunks() if rows.num_rows else pa.array([], pa.string())
    if isinstance(word, pa.ChunkedArray):
        word = word.chunk(0)
    lists = rows.column("ids").combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int32()))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    values, offsets = _list_parts(lists)
    flat = np.append(values.to_numpy(zero_copy_only=False).astype(np.int32), np.int32(-1))
    return word, offsets, np.append(np.diff(offsets), 1), flat


def piece_table(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(id, piece): the bytes of each id of a word-level vocabulary, a table of fixed size."""
    lines = spark.read.text(os.path.join("file://" + folder, f"{name}.tiktoken"))
    part = F.split("value", " ")
    return lines.select(part[1].cast("int").alias("id"), F.unbase64(part[0]).alias("piece"))


def decode_corpus(encoded: DataFrame, pieces: DataFrame) -> DataFrame:
    """(doc_id, text): the text of each row of (doc_id, ids), through a join of each id with its piece.

    The pieces are a vocabulary of fixed size, which is checked before it is broadcast. An empty list gives an empty
    text; an id without a piece, or a null list, gives null. Repeated rows come out as often as they are there.
    """
    known = pieces.select("id", F.hex("piece").alias("piece"))
    known = F.broadcast(known) if known.count() <= HEAD_WORDS else known
    rows = encoded.select("doc_id", F.monotonically_increasing_id().alias("row"), "ids")
    each = rows.select("doc_id", "row", F.col("ids").isNull().alias("lost"), F.posexplode_outer("ids").alias("at", "id")).join(known, "id", "left")
    whole = each.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.bool_or(F.col("lost") | F.col("at").isNotNull() & F.col("piece").isNull()).alias("lost"),
        F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "piece")))).alias("parts"),
    )
    text = F.decode(F.unhex(F.array_join(F.transform("parts", lambda x: x.piece), "")), "UTF-8")
    return whole.select("doc_id", F.when(~F.col("lost"), text).alias("text"))
