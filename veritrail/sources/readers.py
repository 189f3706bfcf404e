"""Sources of documents and tables. Paths are any that Spark reads."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from veritrail.functions import urls
from veritrail.functions.ids import stable_id
from veritrail.functions.text import clean_text, infer_language, infer_title
from veritrail.sources import openxml

#: File endings that a parser exists for, limits of figures, cells and encyclopedia texts.
SUPPORTED = (".pdf", ".doc", ".docx", ".docm", ".pptx", ".xls", ".xlsx")
FIGURE_MIN_WIDTH, FIGURE_MIN_HEIGHT, FIGURE_MIN_BYTES = 200, 120, 8000
CELL_TEXT, ARTICLE_TEXT = 20_000, 100_000
CATEGORY_CORPUS = {"доклады": "internal_reports", "журналы": "scientific_journals", "материалы конференций": "conference_materials", "обзоры": "reviews", "статьи": "scientific_articles"}
ELEMENT = "element_id string, kind string, text string, page_number int, row_number int"


def corpus_of(category: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in CATEGORY_CORPUS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(category))), F.lit("scientific_articles"))


def inventory(spark: SparkSession, root: str, endings: Sequence[str] = SUPPORTED) -> DataFrame:
    """path, category (the first folder), size, sorted by path without regard to case. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"))
    relative = F.regexp_replace(F.col("path"), "^.*?" + re.escape(root.rstrip("/").removeprefix("file://")) + "/", "")
    category = F.when(F.contains(relative, F.lit("/")), F.split(relative, "/")[0]).otherwise("other")
    kept = files.where(F.lower("path").rlike("(?:" + "|".join(re.escape(e) for e in endings) + ")$"))
    return kept.select(relative.alias("path"), category.alias("category"), "size").orderBy(F.lower("path"), "path")


def manifest(spark: SparkSession, path: str, per_category: int = 5, categories: int = 5) -> DataFrame:
    """(category, path) of a manifest in JSON, checked: as many documents as asked in each category, no unsafe paths."""
    rows = spark.read.option("multiLine", True).json(path).select(F.explode("documents").alias("d")).select("d.category", "d.path")
    bad = rows.where(F.col("path").rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)")).count()
    if bad:
        raise ValueError(f"{bad} unsafe paths in the manifest")
    counts = {r["category"]: r["count"] for r in rows.groupBy("category").count().limit(categories + 1).collect()}
    if len(counts) != categories or set(counts.values()) != {per_category}:
        raise ValueError(f"the manifest must have {per_category} documents in each of {categories} categories: {counts}")
    return rows


def parsed_documents(files: DataFrame) -> DataFrame:
    """Document columns for files (path, content): ids, digest, title, language. Text is taken from whole-text files."""
    text = clean_text(F.decode("content", "UTF-8"))
    sha = F.sha2("content", 256)
    name = F.regexp_extract("path", "[^/]*$", 0)
    return files.select(
        stable_id("document", F.lower("path")).alias("document_id"), F.concat(F.lit("docver_"), sha).alias("version_id"), name.alias("file_name"), sha.alias("sha256"),
        F.length("content").alias("size_bytes"), infer_title(text, name).alias("title"), infer_language(text).alias("language"), text.alias("text"),
    )


def table_rows(tables: DataFrame, id_col: str, cells_col: str) -> DataFrame:
    """A text element for each row of a table (array of arrays of cells): cells joined with ' | ', empty rows dropped."""
    rows = tables.select(id_col, F.posexplode(cells_col).alias("row_number", "cells"))
    joined = F.array_join(F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit("")))), " | ")
    return rows.where(F.exists("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")).select(id_col, "row_number", F.substring(joined, 1, CELL_TEXT).alias("text"))


def kept_figures(figures: DataFrame) -> DataFrame:
    """Figures (width, height, bytes, sha256) large enough to matter, each picture once."""
    big = figures.where(f"width >= {FIGURE_MIN_WIDTH} and height >= {FIGURE_MIN_HEIGHT} and bytes >= {FIGURE_MIN_BYTES}")
    return big.dropDuplicates(["sha256"])


def pages_regrouped(elements: DataFrame, doc: str, page: str, order: str, text: str) -> DataFrame:
    """One text for each page: its elements in order."""
    made = elements.groupBy(doc, page).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("e"))
    return made.select(doc, page, F.array_join(F.transform("e", lambda e: e[text]), "\n").alias(text))


def openxml_elements(files: DataFrame) -> DataFrame:
    """path, kind, text, position of word-processing files (path, content): their paragraphs and table rows."""
    return openxml.elements(files).where("kind <> 'error'").select("path", "kind", "text", "position")


def presentations(turns: DataFrame, path: Column, turns_col: str) -> DataFrame:
    """(path, content): a presentation for each row, with a slide for each of its turns (array of structs turn, role, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in openxml.sliced(batches):
            made = [openxml.presentation([(x["text"] or "", [[x["role"] or "", str(x["turn"])]], f"turn {x['turn']}") for x in turns]) for turns in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["path", "content"])

    return turns.select(path.alias("path"), turns_col).mapInArrow(run, "path string, content binary")


def text_documents(texts: DataFrame, path: Column, paragraphs: Column, cells: Column) -> DataFrame:
    """(path, content): a text document for each row, of paragraphs (array of strings) and a table of one row of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in openxml.sliced(batches):
            made = [openxml.text_document([x or "" for x in said or []], [[c or "" for c in row]] if row else []) for said, row in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["path", "content"])

    return texts.select(path.alias("path"), paragraphs.alias("said"), cells.alias("cells")).mapInArrow(run, "path string, content binary")


def workbooks(tables: DataFrame, path: Column, sheet: Column, rows_col: str) -> DataFrame:
    """(path, content): a workbook for each row, of one sheet with its rows (array of arrays of cells)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in openxml.sliced(batches):
            made = [openxml.workbook([(name, [[c or "" for c in row] for row in rows])]) for name, rows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["path", "content"])

    return tables.select(path.alias("path"), sheet.alias("sheet"), rows_col).mapInArrow(run, "path string, content binary")


def workbook_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a delimited sheet as texts: cells joined with ' | ', nulls as empty cells."""
    sheet = spark.read.option("header", True).csv(path)
    cells = F.concat_ws(" | ", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in sheet.columns])
    return sheet.select(F.substring(cells, 1, CELL_TEXT).alias("text"))


def listed_objects(objects: DataFrame) -> DataFrame:
    """Objects of a bucket listing (key, size) without folder markers and empty ones."""
    return objects.where(~F.endswith("key", F.lit("/")) & (F.col("size") > 0))


def merged_parts(parts: DataFrame, upload: str, number: str, content: str) -> DataFrame:
    """Uploaded parts joined in the order of their numbers; uploads that lack a part are left out."""
    made = parts.groupBy(upload).agg(F.array_sort(F.collect_list(F.struct(number, content))).alias("p"), F.max(number).alias("last"), F.count_distinct(number).alias("n"))
    return made.where("last = n").select(upload, F.array_join(F.transform("p", lambda p: p[content]), "").alias(content), "n")


def web_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """id_col, url, title, text; a title that several pages share gets the url's last segment appended."""
    title = F.coalesce(urls.html_title(F.col(html_col)), urls.last_segment(F.col(url_col)))
    made = pages.select(id_col, urls.with_scheme(F.col(url_col)).alias("url"), title.alias("title"), urls.html_text(F.col(html_col)).alias("text"))
    counts = made.groupBy("title").agg(F.count("*").alias("_n"))
    named = made.join(counts, "title")
    return named.select(id_col, "url", F.when(F.col("_n") > 1, F.concat_ws("-", "title", urls.last_segment(F.col("url")))).otherwise(F.col("title")).alias("title"), "text")


def articles(pages: DataFrame, url_col: str, text_col: str) -> DataFrame:
    """lang, title, text of encyclopedia pages, at most ARTICLE_TEXT characters."""
    part = urls.wiki_parts(F.col(url_col))
    return pages.select(part["lang"].alias("lang"), part["title"].alias("title"), F.substring(text_col, 1, ARTICLE_TEXT).alias("text")).where("title is not null")


def upload_jobs(uploads: DataFrame, complete: DataFrame) -> DataFrame:
    """Uploads (sha256, name, size) that need work: each content once, within limits, not already complete."""
    first = uploads.where("size <= 100 * 1024 * 1024").groupBy("sha256").agg(F.min("name").alias("name"), F.max("size").alias("size"))
    return first.join(complete.select("sha256"), "sha256", "left_anti")


def partial_targets(jobs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Jobs (job_id, stage, document_id) that have chunks (document_id, chunk_id), furthest stage first."""
    counted = jobs.join(chunks, "document_id").groupBy("job_id", "stage", "document_id").agg(F.count("*").alias("n_chunks"))
    rank = F.when(F.col("stage") == "complete", 0).when(F.col("stage") == "chunks_loaded", 1).otherwise(2)
    return counted.where("n_chunks > 0").orderBy(rank, "document_id")


def parser_of(path: str) -> str:
    """The ending of a file that there is a parser for."""
    ending = "." + path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if ending not in SUPPORTED:
        raise ValueError(f"unsupported file: {path}")
    return ending


def pseudo_pages(paragraphs: DataFrame, doc: str = "doc", position: str = "position", text: str = "text", breaks: str = "page_break", size: int = 10_000) -> DataFrame:
    """doc, page_number, text: paragraphs buffered to pages. A page closes after a paragraph with a break before it, or with
    the one that takes it over `size` characters. Each close depends on the one before, so a document is folded."""
    made = paragraphs.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(position, F.coalesce(breaks, F.lit(False)).alias("b"), F.coalesce(clean_text(F.col(text)), F.lit("")).alias("t")))).alias("p"))
    start = F.struct(F.lit("").alias("held"), F.array().cast("array<string>").alias("pages"))

    def add(acc, p):
        held = F.when(p["t"] == "", acc["held"]).when(acc["held"] == "", p["t"]).otherwise(F.concat_ws("\n", acc["held"], p["t"]))
        closed = p["b"] | (F.length(held) > size)
        return F.when(closed, F.struct(F.lit("").alias("held"), F.concat(acc["pages"], F.array(held)).alias("pages"))).otherwise(F.struct(held.alias("held"), acc["pages"].alias("pages")))

    pages = F.aggregate("p", start, add, lambda acc: F.when(acc["held"] != "", F.concat(acc["pages"], F.array(acc["held"]))).otherwise(acc["pages"]))
    return made.select(doc, F.posexplode(pages).alias("page_number", text)).where(F.col(text) != "").withColumn("page_number", F.col("page_number") + 1)


def graph_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """(kind, a, b, c) of lines of `kind<TAB>a<TAB>b<TAB>c`, fields that are missing null; blank lines are left out."""
    parts = F.split(line, "\t", -1)
    return lines.where(F.trim(line) != "").select(*[F.get(parts, k).alias(n) for k, n in enumerate(("kind", "a", "b", "c"))])


class GraphTextSource(DataSource):
    """spark.read.format("graphtext"): nodes or edges from lines of `kind<TAB>...`, a plain exchange format."""

    @classmethod
    def name(cls) -> str:
        return "graphtext"

    def schema(self) -> str:
        return "kind string, a string, b string, c string"

    def reader(self, schema) -> DataSourceReader:
        return _GraphTextReader(self.options)


class _GraphTextReader(DataSourceReader):
    def __init__(self, options: dict):
        self.lines = options.get("lines", "").split("\n")
        self.parts = max(1, int(options.get("numpartitions", "2")))

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition(k) for k in range(self.parts)]

    def read(self, partition: InputPartition):
        for line in self.lines[partition.value :: self.parts]:
            if line.strip():
                yield tuple((line.split("\t") + [None] * 4)[:4])
