"""Command line: python -m lodestone.sources.csv_to_xml NEWS.csv FOLDER, a CSV of news (date, title, article) as XML."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .files import write_xml


def main(arguments: list[str]) -> int:
    if len(arguments) != 2:
        print("usage: python -m lodestone.sources.csv_to_xml NEWS.csv FOLDER", file=sys.stderr)
        return 1
    spark = SparkSession.builder.getOrCreate()
    news = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(arguments[0])
    write_xml(news, arguments[1])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
