"""Snippets and result cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens as tokens_of

LEFT, RIGHT = 15, 14
#: Icons by publisher, and the service that gives them. Fixed values.
ICONS = {"guardian": "theguardian", "journal": "thejournal"}
ICON_SERVICE = "https://www.google.com/s2/favicons?sz={size}&domain_url={domain}.com"


def bold_position(positions: Column, title: Column) -> Column:
    """The first position at or after the title's length in characters, else -1."""
    return F.coalesce(F.get(F.filter(positions, lambda p: p >= F.length(F.coalesce(title, F.lit("")))), F.lit(0)), F.lit(-1))


def snippet(tokens: Column, at: Column, body: Column | None = None) -> Column:
    """15 tokens before and 14 after the bold one, between dots; without a bold one the first 15 tokens of the body. tokens: of title and body; body: its own, where there is a title."""
    start = F.greatest(at - LEFT, F.lit(0))
    before, after = F.slice(tokens, start + 1, at - start), F.slice(tokens, at + 2, F.lit(RIGHT))
    plain = F.concat_ws(" ", F.slice(tokens if body is None else body, 1, LEFT))
    return F.when(at < 0, plain).otherwise(F.concat(F.lit("..."), F.concat_ws(" ", before, F.array(F.concat(F.lit("<b>"), F.get(tokens, at), F.lit("</b>"))), after), F.lit("...")))


def favicon(publisher: Column, size: int = 64, service: str = ICON_SERVICE) -> Column:
    name = F.lower(publisher)
    known = F.create_map(*(F.lit(x) for pair in ICONS.items() for x in pair))
    before, after = service.format(size=size, domain="\0").split("\0")
    return F.concat(F.lit(before), F.coalesce(known[name], F.replace(name, F.lit(" "), F.lit(""))), F.lit(after))


def cards(hits: DataFrame, docs: DataFrame, most: int = 5) -> DataFrame:
    """Cards of the first hits (doc_id, positions, rank), in their order: doc_id, title, url, image, date, publisher, sentiment, content.

    docs: (doc_id, title, text, url, date, publisher). The first hits are collected, so that only their documents are
    read and tokenised; a hit without a document has no card.
    """
    spark = hits.sparkSession
    first = [(k, r.doc_id, r.positions) for k, r in enumerate(hits.orderBy("rank", "doc_id").select("doc_id", "positions").limit(most).collect())]
    found = spark.createDataFrame(first, "place int, doc_id bigint, positions array<int>")
    own = docs.where(F.col("doc_id").isin([x for _, x, _ in first])).join(F.broadcast(found), "doc_id")
    body = tokens_of(F.col("text"))
    whole = tokens_of(F.concat_ws(" ", "title", "text"))
    shown = own.select("*", whole.alias("tokens"), body.alias("body")).select(
        "place",
        "doc_id",
        "title",
        "url",
        favicon(F.col("publisher")).alias("image"),
        F.substring("date", 1, 10).alias("date"),
        "publisher",
        F.lit(0.0).alias("sentiment"),
        snippet(F.col("tokens"), bold_position(F.col("positions"), F.col("title")), F.col("body")).alias("content"),
    )
    return shown.orderBy("place").drop("place")
