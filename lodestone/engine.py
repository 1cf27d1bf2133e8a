"""The search interface: spell-correct, parse, match, rank, and show cards, over a stored index."""

from __future__ import annotations

import configparser
import dataclasses
import logging
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import expand, present, rank, store
from .plans import boolean
from .plans.storage import scratch


@dataclass
class Config:
    """Settings. log: which of the four loggers write."""

    results: int = 5
    ranked: int = 150
    mode: str = "tfidf"
    log: dict[str, bool] = field(default_factory=lambda: {"indexer": True, "search": True, "memory": False, "performance": False})

    @classmethod
    def read(cls, path: str) -> Config:
        """From an INI file: section [search] with the settings, section [log] with the loggers."""
        parser = configparser.ConfigParser()
        parser.read(path)
        out = cls()
        for name, value in parser["search"].items() if parser.has_section("search") else ():
            out.set(name, value)
        out.log |= {name: parser.getboolean("log", name) for name in (parser["log"] if parser.has_section("log") else ())}
        return out

    def get(self, name: str):
        return getattr(self, name)

    def set(self, name: str, value) -> None:
        setattr(self, name, type(getattr(self, name))(value))

    def show(self) -> str:
        return "\n".join(f"{k} = {v}" for k, v in dataclasses.asdict(self).items())

    def logger(self, name: str) -> logging.Logger:
        out = logging.getLogger(f"lodestone.{name}")
        out.disabled = not self.log.get(name, False)
        return out


class Engine:
    """Documents (doc_id, text; optional headline, url, date, publisher) and their stored index, which is built in the shared scratch folder when none is given or built."""

    def __init__(self, docs: DataFrame, stored: str | None = None, config: Config | None = None):
        self.docs, self.config = docs, config or Config()
        self._store = store.load(docs.sparkSession, stored) if stored else None

    @property
    def spark(self) -> SparkSession:
        return self.docs.sparkSession

    @property
    def store(self) -> store.Store:
        if self._store is None:
            self.build(scratch(self.spark))
        return self._store

    def build(self, path: str) -> None:
        began = time.time()
        self.config.logger("indexer").info("building %s", path)
        self._store = store.build(self.docs, path)
        self.config.logger("memory").info("index of %s documents", self._store.corpus_stats().first().n)
        self.config.logger("performance").info("indexing took %.3f s", time.time() - began)

    def did_you_mean(self, query: str) -> expand.Correction:
        return expand.check_and_correct(query, self.store.lexicon())

    def correct(self, query: str) -> str:
        return self.did_you_mean(query).text

    def match(self, query: str) -> DataFrame:
        """(doc_id, positions) of a boolean query; none for an empty one."""
        return boolean.stored(query, self.store)

    def ranked(self, query: str) -> DataFrame:
        """(doc_id, score), the best first; none for an empty query."""
        if not query.strip():
            return self.store.documents().where("false").withColumn("score", F.lit(0.0))
        scorers = {"tfidf": rank.tfidf, "bm25": rank.bm25, "vsm": rank.vsm, "vsm_bm25": lambda s, q: rank.vsm(s, q, "bm25")}
        return rank.top(scorers[self.config.mode](self.store, query), self.config.ranked)

    def expanded(self, query: str, mode: str = "prf", table: DataFrame | None = None) -> DataFrame:
        """(doc_id, score) of the query expanded by feedback or by a table of synonyms."""
        found = expand.expand(self.store, self.docs, query, mode, table)
        return rank.top(rank.cosine(self.store, found), self.config.ranked) if mode == "prf" else self.ranked(found)

    def search(self, query: str, correct: bool = False) -> DataFrame:
        """Cards of the first results of a boolean query, in the order of ids."""
        began = time.time()
        query = self.correct(query) if correct else query
        self.config.logger("search").info("%s", query)
        column = lambda name: F.col(name) if name in self.docs.columns else F.lit("")
        rows = self.docs.select("doc_id", column("headline").alias("title"), "text", *(column(x).alias(x) for x in ("url", "date", "publisher")))
        out = present.cards(self.match(query).withColumn("rank", F.lit(0)), rows, self.config.results)
        self.config.logger("performance").info("search (%s) took %.3f s", query, time.time() - began)
        return out
