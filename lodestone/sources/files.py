"""Reading and writing: HTML folders with change detection, XML, CSV, JDBC, rendered pages."""

from __future__ import annotations

import functools
import re
from html import escape, unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ..plans.storage import epochs, written

NEWS = "doc_id bigint, date string, title string, article string, outlet string, lead_paragraph string, authors string, domain string, url string, political_leaning string"


def html_files(spark: SparkSession, roots: list[str], suffix: str = ".html") -> DataFrame:
    """(path, sha256, html) below the roots, at any depth."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(roots)
    return found.select("path", F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("html"))


#: What tells files apart in a manifest. Where several share a path, a caller names further columns.
KEY = ("path",)
MANIFEST = "path string, sha256 string"


def agreed(columns: tuple[str, ...]) -> Column:
    """Whether the sides old and new of a join agree in columns; nulls are equal."""
    return functools.reduce(lambda x, y: x & y, (F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in columns))


def changed(files: DataFrame, manifest: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Files (path, sha256, ...), a row each, that the manifest (path, sha256) lacks or has with another checksum only. key: what names a file in both."""
    old = manifest.select(*key, "sha256").alias("old")
    return files.alias("new").join(old, agreed((*key, "sha256")), "left_anti")


def pruned(manifest: DataFrame, files: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """The manifest without files that are gone."""
    return manifest.alias("old").join(files.select(*key).alias("new"), agreed(key), "left_semi")


def save_manifest(manifest: DataFrame, path: str, key: tuple[str, ...] = KEY) -> None:
    """Keeps (path, sha256) as the next version at path; earlier ones stay as backups."""
    at = max(epochs(manifest.sparkSession, path), default=-1) + 1
    manifest.select(*key, "sha256").write.mode("overwrite").parquet(f"{path}/epoch={at}")


def load_manifest(spark: SparkSession, path: str, schema: str | StructType = MANIFEST) -> DataFrame:
    """The last version kept; empty if there is none."""
    found = epochs(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/epoch={found[-1]}") if found else spark.createDataFrame([], schema)


def change_queue(files: DataFrame, path: str, clear: bool = False, key: tuple[str, ...] = KEY) -> DataFrame:
    """Files (path, sha256, ...) that are new or changed against the manifest kept at path. clear: keeps the files' checksums as the new manifest, without files that are gone, so that the queue is empty until something changes."""
    queue = changed(files, load_manifest(files.sparkSession, path, files.select(*key, "sha256").schema), key)
    if clear:
        queue = written(queue)
        save_manifest(files, path, key)
    return queue


def html_page(spark: SparkSession, root: str, doc_id: int) -> DataFrame:
    """(path, sha256, html) of the page news_<doc_id>.html of a folder; no row if there is none."""
    return html_files(spark, [root], f"news_{doc_id}.html").where(F.col("path").endswith(f"/news_{doc_id}.html"))


def non_empty(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("the corpus is empty")
    return df


def remote_path(path: Column, base: str, marker: str = "collection") -> Column:
    """The part of a local path from the marker on, below base."""
    return F.concat(F.lit(base), F.regexp_extract(path, f"({marker}.*)$", 1))


class _Article(HTMLParser):
    """h1 and p texts; a p ends where the next block starts; scripts and styles are skipped."""

    BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p div article section nav footer header ul ol li table".split())

    def __init__(self):
        super().__init__()
        self.found: dict[str, list[str]] = {"h1": [], "p": []}
        self.open, self.skip = "", 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in self.BLOCKS:
            self.open = tag if tag in self.found else ""
            if self.open:
                self.found[tag].append("")
        elif self.open and self.found[self.open]:
            self.found[self.open][-1] += " "

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in self.BLOCKS:
            self.open = ""

    def handle_data(self, data):
        if self.open and not self.skip:
            self.found[self.open][-1] += data


#: A tag without what HTML allows besides: quoted attributes only, no comment, no slash at the end.
_TAG = re.compile(r'<(?:/([a-zA-Z][a-zA-Z0-9]*)|([a-zA-Z][a-zA-Z0-9]*)(?: +[a-zA-Z][a-zA-Z-]*="[^"<>]*")*)>')
#: Elements whose content isn't HTML; a title without tags in it reads as any other.
_APART = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
_DOCTYPE = "<!DOCTYPE html>"


def plain_tags(page: str) -> list[tuple[str, str, str]] | None:
    """(data before, end tag, start tag) of a page that has only such tags and ends with one; None for any other page."""
    at, found = len(_DOCTYPE) if page.startswith(_DOCTYPE) else 0, []
    for m in _TAG.finditer(page, at):
        before, end, start = page[at : m.start()], (m[1] or "").lower(), (m[2] or "").lower()
        if "<" in before or start in _APART - {"title"} or found and found[-1][2] == "title" and end != "title":
            return None
        found.append((before, end, start))
        at = m.end()
    return found if at == len(page) else None


def article(page: str | None) -> _Article:
    """A page as parsed by _Article: without the parser's own scan where the tags are plain."""
    parser = _Article()
    tags = plain_tags(page or "")
    if tags is None:
        parser.feed(page or "")
        return parser
    for before, end, start in tags:
        if before and parser.open:
            parser.handle_data(unescape(before))
        if end:
            parser.handle_endtag(end)
        else:
            parser.handle_starttag(start, ())
    return parser


@F.pandas_udf(StructType().add("headline", StringType()).add("text", StringType()))
def html_fields(html: pd.Series) -> pd.DataFrame:
    def fields(page: str | None) -> tuple[str, str]:
        parser = article(page)
        return tuple(" ".join(" ".join(x.split()) for x in parser.found[tag] if x.strip()) for tag in ("h1", "p"))

    return pd.DataFrame([fields(x) for x in html], columns=["headline", "text"])


@F.pandas_udf(ArrayType(StringType()))
def html_paragraphs(html: pd.Series) -> pd.Series:
    """All p texts, for access by position."""

    def paragraphs(page: str | None) -> list[str]:
        parser = _Article()
        parser.feed(page or "")
        return [" ".join(x.split()) for x in parser.found["p"]]

    return html.map(paragraphs)


def html_documents(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    return pages.select(F.col(key).alias("doc_id"), html_fields(F.col(html)).alias("f")).select("doc_id", "f.headline", "f.text")


def escaped(text: Column | str) -> Column:
    """html.escape as an expression; null: empty."""
    out = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    for c in "&<>\"'":
        out = F.replace(out, F.lit(c), F.lit(escape(c)))
    return out


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unescape(x) if x is not None else None)


def rendered(news: DataFrame) -> DataFrame:
    """(doc_id, outlet_key, html): a page per row; outlet_key is the last word of the outlet, lower-cased."""
    tag = lambda name, id_, column: F.concat(F.lit(f'<{name} id="{id_}">'), escaped(column), F.lit(f"</{name}>"))
    meta = lambda id_: F.concat(F.lit(f'<meta name="{id_}" content="'), escaped(id_), F.lit(f'" id="{id_}" hidden="true">'))
    said = lambda before, column: F.concat(F.lit(before), F.coalesce(column, F.lit("")))
    body = F.concat(F.lit("<p>"), F.replace(escaped("article"), F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"))
    page = F.concat(F.lit('<!DOCTYPE html><html><head><title>News</title><link href="../styling/news_style.css" rel="stylesheet"><meta charset="utf-8">'), meta("lead_paragraph"), meta("domain"), meta("url"), F.lit("</head><body>"), tag("h3", "outlet", said("Publication outlet: ", F.col("outlet"))), tag("h4", "political_leaning", "political_leaning"), tag("h1", "title", "title"), tag("h4", "authors", said("Written by: ", F.col("authors"))), tag("sub", "date", said("Published ", F.col("date"))), F.lit('<div id="article">'), body, F.lit("</div></body></html>"))
    return news.select("doc_id", F.element_at(F.split(F.lower("outlet"), " "), -1).alias("outlet_key"), page.alias("html"))


def save_html(news: DataFrame, path: str) -> None:
    rendered(news).select("outlet_key", F.col("html").alias("value")).write.mode("overwrite").partitionBy("outlet_key").text(path)


def read_xml(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("rowTag", "DOC")
    return (reader.schema(schema) if schema else reader).xml(path)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows in an order with numbers from 1. They are sorted over all tasks and written; counts of the partitions, as many as there are tasks, give each its first number."""
    placed = written(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = sizes.select("_part", before.alias("_before"))
    return placed.join(F.broadcast(firsts), part == F.col("_part")).withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_part", "_before")


def write_xml(news: DataFrame, path: str) -> None:
    """DOCNO from 1 by date and title; DATE as yyyy-MM-dd."""
    numbered_news = numbered(news, ["date", "title"], "DOCNO").select("DOCNO", F.date_format(F.to_timestamp("date"), "yyyy-MM-dd").alias("DATE"), F.col("title").alias("HEADLINE"), F.col("article").alias("TEXT"))
    numbered_news.write.mode("overwrite").option("rowTag", "DOC").option("rootTag", "document").xml(path)


def xml_to_rows(docs: DataFrame, *kept: str) -> DataFrame:
    """(news_title, text) with defaults for what is missing, after the columns kept."""
    clean = lambda c: F.nullif(F.trim(F.regexp_replace(F.col(c), r"\s+", " ")), F.lit(""))
    return docs.select(*kept, F.coalesce(clean("HEADLINE"), F.lit("No Title Found")).alias("news_title"), F.coalesce(clean("TEXT"), F.lit("No Text Found")).alias("text"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str]) -> DataFrame:
    """A database table; credentials come from properties."""
    return spark.read.jdbc(url, table, properties=properties)


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str]) -> None:
    df.write.jdbc(url, table, mode="overwrite", properties=properties)
