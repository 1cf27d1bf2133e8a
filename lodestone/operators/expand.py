"""Spelling correction, suggestion and query expansion over the lexicon."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenise
from . import rank


class Correction(NamedTuple):
    """A corrected text, the words changed as (word, correction), and whether there are any."""

    text: str
    corrections: list[tuple[str, str]]
    changed: bool


def check_and_correct(text: str, terms: DataFrame) -> Correction:
    """Corrects the words of a query; operators in upper case and known words stay, and so does what surrounds a word."""
    words = [(w,) for w in dict.fromkeys(tokenise(text))]
    found = {r.word: r.correction for r in spell_correct(terms.sparkSession.createDataFrame(words, "word string"), terms).collect()} if words else {}
    changed: dict[str, str] = {}

    def corrected(m: re.Match) -> str:
        word = m[0]
        new = found.get(word.lower(), word.lower())
        if word.isupper() or new == word.lower():
            return word
        changed[word] = new
        return new

    out = re.sub(r"[^\W_]+", corrected, text)
    return Correction(out, list(changed.items()), bool(changed))


def spell_correct(words: DataFrame, terms: DataFrame, distance: int = 2) -> DataFrame:
    """(word, correction, distance) for each row of words (word): the lexicon's nearest term, then the most frequent, then by name; the word itself if none is near. words: a query's few words, broadcast; terms: (term, df)."""
    near = terms.join(F.broadcast(words.distinct()), F.abs(F.length("term") - F.length("word")) <= distance).withColumn("d", F.levenshtein("term", "word", distance)).where("d >= 0")
    best = near.groupBy("word").agg(F.min(F.struct("d", (-F.col("df")).alias("f"), "term")).alias("b")).select("word", F.col("b.term").alias("found"), F.col("b.d").alias("d"))
    return words.join(best, "word", "left").select("word", F.coalesce("found", "word").alias("correction"), F.coalesce(F.col("d"), F.lit(-1)).alias("distance"))


def prefix_suggest(terms: DataFrame, prefix: str, k: int = 10) -> DataFrame:
    return terms.where(F.col("term").startswith(prefix)).orderBy(F.desc("df"), "term").limit(k)


def synonyms(words: DataFrame, table: DataFrame, most: int = 3) -> DataFrame:
    """Of at most `most` words of a query (chosen by hash) that have a synonym, one each: (word, synonym). table: (word, synonym)."""
    other = table.where("word != synonym").join(F.broadcast(words.distinct()), "word")
    chosen = other.select("word").distinct().orderBy(F.xxhash64("word"), "word").limit(most)
    ranked = other.join(F.broadcast(chosen), "word").withColumn("r", F.row_number().over(Window.partitionBy("word").orderBy(F.xxhash64("synonym"), "synonym")))
    return ranked.where("r = 1").drop("r")


def expand(store, docs: DataFrame, query: str, mode: str = "prf", table: DataFrame | None = None):
    """By mode: prf, the expanded vector (term, qw) that rank.cosine takes; syn, the query string with the synonyms of up to three of its words appended."""
    if mode == "prf":
        return rank.feedback(store, docs, query).withColumnRenamed("weight", "qw")
    if mode != "syn" or table is None:
        raise ValueError("mode is prf, or syn with a table of synonyms")
    words = store.spark.createDataFrame([(w,) for w in dict.fromkeys(tokenise(query))] or [("",)], "word string")
    return " ".join([query, *(r.synonym for r in synonyms(words, table).orderBy("word").collect())])
