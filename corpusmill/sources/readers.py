"""Readers: delimited and JSON tables, whole files, listings, captured pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Encodings in the order of trial, and supported extensions.
ENCODINGS = ("utf-8", "gbk", "gb2312", "iso-8859-1")
EXTENSIONS = ("pdf", "docx", "doc", "xlsx", "xls", "csv", "pptx", "ppt", "md", "markdown", "txt", "html", "htm", "json", "tsv")


def read_delimited(spark: SparkSession, path: str, sep: str = ",", sample: int = 1000) -> DataFrame:
    """A table with a header and inferred types, in the first encoding in which sampled lines have no replacement character."""
    for encoding in ENCODINGS:
        lines = spark.read.option("encoding", encoding).option("header", False).option("sep", "\x00").csv(path).limit(sample)
        if lines.where(F.contains("_c0", F.lit("�"))).isEmpty():
            break
    return spark.read.csv(path, header=True, inferSchema=True, sep=sep, encoding=encoding)


def read_records(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """JSON records, one per line or in one array."""
    return spark.read.option("multiLine", array).json(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, size, modified) of whole files."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified"))


def list_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS, hashed: bool = True) -> DataFrame:
    """(path, size, modified, hash) of the files of a tree with a supported extension, each once."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = rows.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(list(extensions)))
    columns = ["path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    return rows.select(*columns, F.sha2("content", 256).alias("hash")) if hashed else rows.select(*columns)


# Pages -----------------------------------------------------------------------------------------------------------------

# Elements of a page that hold no text of it.
_SKIP = "script|style|nav|footer|header|aside|noscript"


def page_text(html: Column) -> Column:
    """Text of a page by patterns alone: skipped parts go, tags become line breaks, entities their characters, blank lines go."""
    text = F.regexp_replace(html, rf"(?is)<({_SKIP})[^>]*>.*?</({_SKIP})>", "\n")
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", ""), r"(?s)<[^>]*>", "\n")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def page_title(html: Column, default: str = "untitled") -> Column:
    """The title, else the first heading without tags, else the default; at most 100 characters."""
    inner = lambda tag: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), r"<[^>]*>", "")), F.lit(""))
    return F.substring(F.coalesce(inner("title"), inner("h1"), F.lit(default)), 1, 100)


def captured(url: Column, html: Column) -> Column:
    """A page's text under a header that tells where it is from."""
    return F.concat(F.lit("source: "), url, F.lit("\ntitle: "), page_title(html), F.lit("\n\n"), page_text(html))


class _Markdown(HTMLParser):
    """Markdown of a page's article, else its main part, else its body."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: dict[str, list[str]] = {"article": [], "main": [], "body": []}
        self.inside: list[str] = []
        self.skip = 0
        self.text: list[str] = []
        self.block = ""
        self.lists: list[list] = []
        self.row: list[str] | None = None
        self.rows: list[list[str]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SKIP.split("|"):
            self.skip += 1
        elif self.skip:
            return
        elif tag in ("article", "main"):
            self.flush()
            self.inside.append(tag)
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.flush()
            self.block = "#" * int(tag[1]) + " "
        elif tag in ("p", "div", "section"):
            self.flush()
        elif tag == "blockquote":
            self.flush()
            self.block = "> "
        elif tag in ("ul", "ol"):
            self.flush()
            self.lists.append([tag, 0])
        elif tag == "li":
            self.flush()
            if self.lists:
                self.lists[-1][1] += 1
            self.block = f"{self.lists[-1][1]}. " if self.lists and self.lists[-1][0] == "ol" else "- "
        elif tag == "table":
            self.flush()
            self.rows = []
        elif tag == "tr":
            self.row = []
        elif tag == "br":
            self.text.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIP.split("|"):
            self.skip = max(0, self.skip - 1)
        elif self.skip:
            return
        elif tag in ("td", "th") and self.row is not None:
            self.row.append(" ".join("".join(self.text).split()).replace("|", "\\|"))
            self.text = []
        elif tag == "tr" and self.row is not None:
            self.rows.append(self.row)
            self.row = None
        elif tag == "table":
            self.put(markdown_table(self.rows))
            self.rows = []
        elif tag in ("ul", "ol"):
            self.flush()
            self.lists = self.lists[:-1]
        elif tag in ("p", "li", "blockquote", "div", "section", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.flush()
        elif tag in self.inside:
            self.flush()
            self.inside.remove(tag)

    def handle_data(self, data: str) -> None:
        if not self.skip and not (self.inside == [] and self.getpos() == (0, 0)):
            self.text.append(data)

    def put(self, block: str) -> None:
        if block:
            for name in {"body", *self.inside}:
                self.parts[name].append(block)

    def flush(self) -> None:
        if self.row is None:
            own = " ".join("".join(self.text).split())
            self.put(self.block + own if own else "")
            self.text, self.block = [], ""


def markdown_table(rows: list[list[str]], most: int = 30) -> str:
    """Ragged rows padded, the first as header, at most so many and a note."""
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join([*r, *[""] * (width - len(r))]) + " |" for r in rows]
    out = [lines[0], "|" + " --- |" * width, *lines[1:most]]
    return "\n".join([*out, f"... {len(rows) - most} more rows"] if len(rows) > most else out)


def to_markdown(html: str | None) -> str:
    parser = _Markdown()
    parser.feed(html or "")
    parser.flush()
    best = next((p for p in (parser.parts["article"], parser.parts["main"]) if p), parser.parts["body"])
    return "\n\n".join(best)


def pages_to_markdown(pages: DataFrame) -> DataFrame:
    """(page_id, markdown) of pages (page_id, html): a job without a shuffle; results under 20 characters fall back to plain text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"page_id": batch["page_id"], "markdown": [to_markdown(h) for h in batch["html"]], "plain": batch["plain"]})

    rows = pages.select("page_id", "html", page_text(F.col("html")).alias("plain")).mapInPandas(run, "page_id long, markdown string, plain string")
    return rows.select("page_id", F.when(F.length("markdown") < 20, F.col("plain")).otherwise(F.col("markdown")).alias("markdown"))
