"""Archives of documents: scan, roles, provenance records, rosters in HTML tables, stage files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "path string, sha1 string, table int, row int, columns array<string>, cells array<string>, raw string"


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, extension, modified, length, content) of every file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("extension"), F.col("modificationTime").alias("modified"), "length", "content")


def with_role(files: DataFrame, rules: Sequence[tuple[str, str]], otherwise: str = "other") -> DataFrame:
    """files with the role of the first pattern that matches name."""
    role: Column | None = None
    for pattern, label in rules:
        role = F.when(F.col("name").rlike(pattern), label) if role is None else role.when(F.col("name").rlike(pattern), label)
    return files.withColumn("role", F.lit(otherwise) if role is None else role.otherwise(otherwise))


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[int, int, list[str]]] = []
        self._table, self._row, self._cells, self._text = -1, -1, None, None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self._table, self._row = self._table + 1, -1
        elif tag == "tr":
            self._row, self._cells = self._row + 1, []
        elif tag in ("td", "th"):
            self._text = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th") and self._text is not None and self._cells is not None:
            self._cells.append(" ".join("".join(self._text).split()))
            self._text = None
        elif tag == "tr" and self._cells is not None:
            self.rows.append((self._table, self._row, self._cells))
            self._cells = None

    def handle_data(self, data: str) -> None:
        if self._text is not None:
            self._text.append(data)


def table_rows(files: DataFrame, encodings: Sequence[str] = ("utf-8", "cp1256")) -> DataFrame:
    """Records of all HTML tables with their place: the first encoding that decodes a file is taken."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, sha1, content in zip(batch["path"], batch["sha1"], batch["content"], strict=True):
                for encoding in encodings:
                    try:
                        text = bytes(content).decode(encoding)
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    text = bytes(content).decode(encodings[0], "replace")
                parser = _Tables()
                parser.feed(text)
                parser.close()
                header: dict[int, list[str]] = {}
                for table, row, cells in parser.rows:
                    header.setdefault(table, cells)
                    out.append((path, sha1, table, row, header[table], cells, " | ".join(cells)))
            yield pd.DataFrame(out, columns=["path", "sha1", "table", "row", "columns", "cells", "raw"])

    return files.select("path", F.sha1("content").alias("sha1"), "content").mapInPandas(run, RECORD)


def roster(records: DataFrame, code: str, name: str) -> DataFrame:
    """(path, code, name, duplicate) of table rows below a header that has both columns."""
    at = lambda c: F.array_position("columns", F.lit(c)).cast("int")
    rows = records.where((F.col("row") > 0) & (at(code) > 0) & (at(name) > 0))
    told = rows.select("path", F.get("cells", at(code) - 1).alias("code"), F.get("cells", at(name) - 1).alias("name"))
    counts = told.groupBy("path", "code").agg(F.count("*").alias("_n"))
    return told.join(counts, ["path", "code"]).select("path", "code", "name", (F.col("_n") > 1).alias("duplicate"))


def write_stage(df: DataFrame, path: str) -> DataFrame:
    """A batch's stage as JSON lines; a stage that is complete is read, not computed again."""
    spark = df.sparkSession
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        df.write.mode("overwrite").json(path)
    return spark.read.schema(df.schema).json(path)
