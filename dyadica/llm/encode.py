"""Encoding of a whole corpus with a byte-level BPE, and decoding, by higher-order functions.

Texts are split into words by the tokenizer's pattern in the JVM. Each distinct word of the
corpus is encoded once: a fold over its bytes merges, again and again, the neighbours whose
union has the lowest rank. Ranks come from a literal: an array of small maps, found by a
checksum, because a map is searched from end to end. The encoded words are a literal of the same kind, in which each text's words
are looked up where the text is; a vocabulary too large for that is joined by a shuffle. Bytes are held as the characters 0 to 255 of a string.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadica.llm import vocab
from dyadica.operators.skew import lookup_join
from dyadica.session import stored

#: Maps in the rank literal: about six entries each.
MAPS = 8192
#: Words of more bytes are merged by the heap of the public library, to the same ids: the fold's cost grows with the square of a word's length.
LONG = 96
#: The encoded words are looked up in a literal if there are at most so many, of so many bytes; else joined by a shuffle.
LITERAL_WORDS, LITERAL_BYTES = 200_000, 12_000_000


def _literal(entries: Iterable[tuple[str, object]], kind: str) -> Column:
    maps: list[dict[str, object]] = [{} for _ in range(MAPS)]
    for key, value in entries:
        maps[zlib.crc32(key.encode()) % MAPS][key] = value
    return F.from_json(F.lit(json.dumps(maps)), f"array<map<string,{kind}>>")


def _found(literal: Column, key: Column) -> Column:
    return F.get(literal, (F.crc32(key.cast("binary")) % MAPS).cast("int"))[key]


def _short(word: Column) -> Column:
    """A key of bounded length: a long word's digest after a zero, which no word has next to letters."""
    return F.when(F.octet_length(word) > 200, F.concat(F.lit("\0"), F.sha2(word.cast("binary"), 256))).otherwise(word)


def rank_literal(ranks: dict[bytes, int]) -> Column:
    return _literal(((token.decode("latin-1"), rank) for token, rank in ranks.items()), "int")


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def merged_ids(word: Column, ranks: Column) -> Column:
    """The ids of ``word``, by folding ranked merges over its bytes."""

    def rank_of(piece: Column) -> Column:
        return _found(ranks, piece)

    def best_merge(acc: Column, r: Column) -> Column:
        def put(at: Column) -> Column:
            one = F.array(F.concat(F.get(acc["p"], at - 1), F.get(acc["p"], at)))
            return F.struct(F.lit(False).alias("done"), F.concat(F.slice(acc["p"], 1, at - 1), one, F.slice(acc["p"], at + 2, F.size(acc["p"]))).alias("p"))

        least = F.array_min(r)
        return F.when(least.isNull(), F.struct(F.lit(True).alias("done"), acc["p"].alias("p"))).otherwise(_let(F.array_position(r, least).cast("int"), put))

    def step(acc: Column, _: Column) -> Column:
        pairs = F.transform(F.slice(acc["p"], 2, F.size(acc["p"])), lambda b, i: rank_of(F.concat(F.get(acc["p"], i), b)))
        return F.when(acc["done"] | (F.size(acc["p"]) < 2), acc).otherwise(_let(pairs, lambda r: best_merge(acc, r)))

    def fold(s: Column) -> Column:
        chars = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, i, F.lit(1)))
        start = F.struct(F.lit(False).alias("done"), chars.alias("p"))
        return F.transform(F.aggregate(F.sequence(F.lit(1), F.length(s)), start, step)["p"], rank_of)

    return _let(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), lambda s: _let(rank_of(s), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(fold(s))))


def words_of(text: Column) -> Column:
    """The words that the merges stay within; ``(?U)`` makes blanks those of Unicode."""
    return F.regexp_extract_all(text, F.lit("(?U)" + vocab.PATTERN), F.lit(0))


def encode_words(words: DataFrame, name: str, folder: str = vocab.FOLDER) -> DataFrame:
    """word, ids for each row of ``words``."""
    ranks = vocab.read_ranks(name, folder)

    @F.pandas_udf("array<int>")
    def by_heap(w: pd.Series) -> pd.Series:
        enc = vocab.encoding(name, folder)
        return w.map(enc.encode_ordinary)  # a word is one match of the pattern by itself too

    short = F.octet_length("word") <= LONG
    return words.where(short).select("word", merged_ids(F.col("word"), rank_literal(ranks)).alias("ids")).unionByName(words.where(~short).select("word", by_heap("word").alias("ids")))


def encode(docs: DataFrame, name: str = "byte_bpe_50k", *, doc_id: str = "doc_id", text: str = "text", folder: str = vocab.FOLDER) -> DataFrame:
    """``doc_id`` and ``ids`` of each row of ``docs``.

    A null or empty text gives an empty list; strings that look like special tokens are ordinary
    text. A row delivered twice comes out twice. Other columns of ``docs`` are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), words_of(F.coalesce(F.col(text), F.lit(""))).alias("words"))
    distinct = rows.select(F.explode("words").alias("word")).distinct().repartition(max(8, docs.sparkSession.sparkContext.defaultParallelism), "word")
    known = stored(encode_words(stored(distinct), name, folder))  # the words are written, as short and long ones are read apart
    size = known.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("word") + 4 * F.size("ids")).alias("b")).first()
    if size["n"] <= LITERAL_WORDS and (size["b"] or 0) <= LITERAL_BYTES:
        ids = _literal(((r["k"], r["ids"]) for r in known.select(_short(F.col("word")).alias("k"), "ids").collect()), "array<int>")
        return rows.select("doc_id", F.flatten(F.transform("words", lambda w: _found(ids, _short(w)))).alias("ids"))
    # each row by a number of its own, since ids may repeat; written, so that the numbers are the same whenever they are read
    own = stored(rows.withColumn("_row", F.monotonically_increasing_id()))
    tokens = own.select("_row", "doc_id", F.posexplode_outer("words").alias("pos", "word"))
    tokens = lookup_join(tokens, known, ["word"])
    together = tokens.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.when(F.col("ids").isNotNull(), F.struct("pos", "ids"))).alias("w"))
    return together.select("doc_id", F.flatten(F.transform(F.array_sort("w"), lambda x: x["ids"])).alias("ids"))


def decode(encoded: DataFrame, name: str = "byte_bpe_50k", folder: str = vocab.FOLDER) -> DataFrame:
    """``doc_id`` and ``text``: the binary pieces of the ids, put together. A null list gives null, an unknown id is left out."""
    ranks = vocab.read_ranks(name, folder)
    pieces = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.decode("latin-1")
    literal = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    joined = F.array_join(F.transform("ids", lambda i: F.get(literal, i)), "")
    return encoded.select("doc_id", F.decode(F.encode(joined, "ISO-8859-1"), "UTF-8").alias("text"))
