"""Readers of course material: Markdown, notebooks, slide decks, JSON and JSONL; writers that resume."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "doc_id string, arquivo string, pagina int, texto string"
_NOTEBOOK = "cells array<struct<cell_type:string,source:string>>"


def _files(spark: SparkSession, folder: str, *suffixes: str) -> DataFrame:
    """(doc_id, content) of the files below ``folder`` with one of the suffixes, whatever their case."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return found.where(F.lower(name).rlike(r"\.(" + "|".join(suffixes) + ")$")).select(name.alias("doc_id"), "content")


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """One page per Markdown file; bytes that are no UTF-8 are dropped."""
    text = F.replace(F.decode("content", "UTF-8"), F.lit("�"), F.lit(""))
    return _files(spark, folder, "md", "markdown").select("doc_id", F.col("doc_id").alias("arquivo"), F.lit(1).alias("pagina"), text.alias("texto")).where(F.trim("texto") != "")


def notebooks(spark: SparkSession, folder: str) -> DataFrame:
    """One page per notebook: Markdown and code cells under a heading with their number, images left out; broken files have none."""
    # A cell's source is a text or a list of lines; as JSON text both are read.
    cells = F.from_json(F.decode("content", "UTF-8"), "cells array<struct<cell_type:string,source:string>>")["cells"]
    rows = _files(spark, folder, "ipynb").select("doc_id", F.posexplode(cells).alias("n", "celula"))
    lines = F.from_json("celula.source", "array<string>")
    source = F.coalesce(F.array_join(lines, ""), F.col("celula.source"))
    clean = F.trim(F.regexp_replace(F.regexp_replace(source, r"(?is)<img[^>]*>", ""), r"data:image/[A-Za-z0-9.+-]+;base64,[A-Za-z0-9+/=]+", ""))
    kept = rows.where(F.col("celula.cell_type").isin("markdown", "code")).select("doc_id", "n", clean.alias("t")).where(F.col("t") != "")
    part = F.concat(F.lit("# celula "), (F.col("n") + 1).cast("string"), F.lit("\n"), F.col("t"))
    pages = kept.select("doc_id", F.struct("n", part.alias("p")).alias("s")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["p"]), "\n\n").alias("texto"))
    return pages.select("doc_id", F.col("doc_id").alias("arquivo"), F.lit(1).alias("pagina"), "texto")


def slides(spark: SparkSession, folder: str) -> DataFrame:
    """One page per slide with text; a page keeps its slide's number. Broken archives have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, content in zip(batch["doc_id"], batch["content"]):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    continue
                numbered = sorted((int(m[1]), n) for n in archive.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
                rows += [(doc, k, archive.read(n).decode("utf-8", "ignore")) for k, (_, n) in enumerate(numbered, 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "pagina", "xml"])

    xml = _files(spark, folder, "pptx").mapInPandas(run, "doc_id string, pagina int, xml string")
    texts = F.filter(F.xpath("xml", F.lit('//*[local-name()="t"]/text()')), lambda t: F.length(F.trim(t)) >= 2)
    return xml.select("doc_id", F.col("doc_id").alias("arquivo"), "pagina", F.array_join(texts, "\n").alias("texto")).where("texto <> ''")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of all readable files, with the title found in their text."""
    from lavra.functions.quality import title

    found = markdown(spark, folder).unionByName(notebooks(spark, folder)).unionByName(slides(spark, folder))
    return found.withColumn("titulo", title(F.col("texto")))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSONL file; lines that are no JSON are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def golden_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a golden set: the list under ``perguntas``."""
    schema = "perguntas array<struct<id:int,pergunta:string,estrato:string,docs_esperados:array<string>,deve_abster:boolean>>"
    return spark.read.schema(schema).option("multiLine", "true").json(path).select(F.explode("perguntas").alias("p")).select("p.*")


def append_missing(rows: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key is not stored yet; the number appended. Run again, it appends nothing."""
    spark = rows.sparkSession
    try:
        done = spark.read.parquet(path).select(key).distinct()
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        done = None
    fresh = rows if done is None else rows.join(done, key, "left_anti")
    before = 0 if done is None else spark.read.parquet(path).count()
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def filled(rows: DataFrame, verdicts: DataFrame, key: str, column: str) -> DataFrame:
    """``rows`` with ``column`` taken from ``verdicts`` where it is null."""
    other = verdicts.select(key, F.col(column).alias("_novo"))
    return rows.join(other, key, "left").withColumn(column, F.coalesce(column, "_novo")).drop("_novo")
