"""Cutting texts into chunks, and chunks into parents."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARENT = 4
# Separators after which a long text is cut, by preference.
SEPARATORS = ("\n", "。", "！", "？", ". ", "! ", "? ", "；", "; ")


def stride_chunks(docs: DataFrame, size: int = 768, overlap: int = 96) -> DataFrame:
    """Windows of size characters at every size - overlap; one row per window, without a shuffle."""
    step = size - overlap
    last = F.greatest(F.lit(1), F.ceil((F.length("text") - overlap) / F.lit(float(step)))).cast("int") - 1
    rows = docs.where(F.length("text") > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("idx"))
    rows = rows.withColumn("content", F.substring(F.col("text"), F.col("idx") * step + 1, F.lit(size)))
    return rows.select(
        F.concat_ws("_", F.col("doc_id").cast("string"), F.col("idx").cast("string")).alias("chunk_id"), "doc_id", "idx", "content",
        F.floor(F.length("content") / 2).cast("int").alias("token_count"), (F.col("idx") * step).alias("start_char"), (F.col("idx") * step + F.length("content")).alias("end_char"),
    )


def cut_long(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Windows of at most size characters, each ended after the last separator in its last three tenths, if any."""
    places = [[m.start() for m in re.finditer(re.escape(sep), text)] for sep in SEPARATORS]

    def end_of(start: int) -> int:
        if start + size >= len(text):
            return len(text)
        for sep, own in zip(SEPARATORS, places, strict=True):
            last = bisect_right(own, start + size - len(sep)) - 1
            if last >= 0 and own[last] > start + int(size * 0.7):
                return own[last] + len(sep)
        return start + size

    spans = [(0, end_of(0))] if text else []
    while spans and spans[-1][1] < len(text):
        start = max(spans[-1][1] - overlap, spans[-1][0] + 1)
        spans.append((start, end_of(start)))
    return spans


def _merged(parts: list[tuple[int, int]], text: str, size: int) -> list[tuple[int, int]]:
    """Neighbouring spans joined while the whole stays within size."""
    out: list[tuple[int, int]] = []
    for a, b in parts:
        own = text[a:b].strip()
        if not own:
            continue
        a = text.index(own[0], a) if not text[a : a + 1].strip() else a
        b = a + len(text[a:b].rstrip())
        if out and b - out[-1][0] <= size:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _spans(pattern: str, text: str) -> list[tuple[int, int]]:
    """Spans between the matches of a pattern."""
    cuts = [(m.start(), m.end()) for m in re.finditer(pattern, text)]
    return list(zip([0, *[b for _, b in cuts]], [*[a for a, _ in cuts], len(text)], strict=True))


def prose(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Paragraphs joined up to size; longer ones cut."""
    return [(a + x, a + y) for a, b in _merged(_spans(r"\n\s*\n", text), text, size) for x, y in cut_long(text[a:b], size, overlap)]


def table_lines(text: str, size: int, overlap: int = 0) -> list[tuple[int, int]]:
    """Whole lines joined up to size; a line of size or more alone; a line that begins with [x] begins a chunk."""
    out: list[tuple[int, int]] = []
    open_, at = False, 0
    for line in text.split("\n"):
        a, b = at, at + len(line)
        at = b + 1
        if not line.strip():
            continue
        if len(line) >= size:
            out.append((a, b))
            open_ = False
        elif open_ and not (line.startswith("[") and "]" in line) and b - out[-1][0] <= size:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
            open_ = True
    return out


def slides(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """One chunk per slide heading, longer ones cut."""
    starts = [0, *[m.start() for m in re.finditer(r"(?m)^## Slide \d+$", text) if m.start()], len(text)]
    return [(a + x, a + y) for a, b in zip(starts, starts[1:], strict=False) if text[a:b].strip() for x, y in cut_long(text[a:b], size, overlap)]


def headed(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Sections between Markdown headings, short ones joined, long ones cut; headings inside fenced code do not count."""
    fences = [(m.start(), m.end()) for m in re.finditer(r"(?s)```[^\n]*\n.*?\n```", text)]
    heads = [m.start() for m in re.finditer(r"(?m)^#{1,6}\s+", text) if m.start() and not any(a <= m.start() < b for a, b in fences)]
    starts = [0, *heads, len(text)]
    return [(a + x, a + y) for a, b in _merged(list(zip(starts, starts[1:], strict=False)), text, size) for x, y in cut_long(text[a:b], size, overlap)]


PAGE = re.compile(r"(?m)^--- Page (\d+) ---\n?")
HEADING = re.compile(r"^(?:#{1,6}\s+|\d+(?:\.\d+)*[.、]?\s+|第.{1,9}[章节]|[一二三四五六七八九十]+、).{0,38}[^。！？.!?；;]$")


def paged(text: str, size: int, overlap: int) -> list[tuple[int, int, int | None, str | None]]:
    """Pages by their markers, sections by heading lines; each chunk with its page and heading."""
    marks = list(PAGE.finditer(text))
    if not marks:
        return [(a, b, None, None) for a, b in prose(text, size, overlap)]
    out, heading = [], None
    for m, end in zip(marks, [*[x.start() for x in marks[1:]], len(text)], strict=True):
        at, cuts = m.end(), [(m.end(), heading)]
        for line in text[m.end() : end].split("\n"):
            if len(line.strip()) <= 40 and HEADING.match(line.strip()):
                heading = line.strip()
                cuts.append((at, heading))
            at += len(line) + 1
        for (a, head), b in zip(cuts, [*[c for c, _ in cuts[1:]], end], strict=True):
            out += [(a + x, a + y, int(m[1]), head) for x, y in prose(text[a:b], size, overlap)]
    return out


CUTTERS = {"text": prose, "table": table_lines, "slides": slides, "headed": headed}


def chunk_documents(docs: DataFrame, size: int = 768, overlap: int = 96) -> DataFrame:
    """docs (doc_id, text, format) cut as their format asks: text, table, slides, headed or paged. A job over documents without a shuffle; chunks that are blank are left out and keep their number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, kind in zip(batch["doc_id"], batch["text"], batch["format"], strict=True):
                text = (text or "").replace("\r\n", "\n")
                spans = paged(text, size, overlap) if kind == "paged" else [(a, b, None, None) for a, b in CUTTERS.get(kind, prose)(text, size, overlap)]
                for k, (a, b, page, heading) in enumerate(spans):
                    own = text[a:b].strip()
                    if own:
                        a += len(text[a:b]) - len(text[a:b].lstrip())
                        rows.append((f"{doc_id}_{k}", doc_id, k, own, len(own) // 2, a, a + len(own), page, heading))
            yield pd.DataFrame(rows, columns=["chunk_id", "doc_id", "idx", "content", "token_count", "start_char", "end_char", "page_num", "heading"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text", "format").mapInPandas(run, f"chunk_id string, doc_id {kind}, idx int, content string, token_count int, start_char int, end_char int, page_num int, heading string")


def slide_parts(docs: DataFrame) -> DataFrame:
    """(doc_id, idx, content): texts split before each slide heading, in SQL functions alone."""
    parts = F.filter(F.transform(F.split("text", r"(?m)(?=^## Slide \d+$)"), lambda p: F.trim(p)), lambda p: p != "")
    return docs.select("doc_id", F.posexplode(parts).alias("idx", "content"))


# Parents ---------------------------------------------------------------------------------------------------------------

def _in_doc() -> Window:
    return Window.partitionBy("doc_id").orderBy("idx")


def capacity_parents(chunks: DataFrame, members: int = PARENT) -> DataFrame:
    """Each chunk with the joined text of its group of consecutive chunks."""
    group = F.floor((F.row_number().over(_in_doc()) - 1) / members).cast("long")
    return _with_parent(chunks.withColumn("grp", group))


def heading_run_parents(chunks: DataFrame, members: int = PARENT) -> DataFrame:
    """A new run starts where the heading is not empty and not the last one; runs are cut every few members."""
    before = F.last(F.nullif("heading", F.lit("")), ignorenulls=True).over(_in_doc().rowsBetween(Window.unboundedPreceding, -1))
    new = F.when((F.coalesce("heading", F.lit("")) != "") & ~F.coalesce(before == F.col("heading"), F.lit(False)), 1).otherwise(0)
    return _run_parents(chunks, new, members)


def heading_start_parents(chunks: DataFrame, members: int = PARENT) -> DataFrame:
    """A new run starts at each chunk whose first line is a Markdown heading."""
    return _run_parents(chunks, F.when(F.col("content").rlike(r"^#{1,6}\s+"), 1).otherwise(0), members)


def _run_parents(chunks: DataFrame, new: Column, members: int) -> DataFrame:
    rows = chunks.withColumn("new", new).withColumn("run", F.sum("new").over(_in_doc()))
    inside = F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("idx"))
    return _with_parent(rows.withColumn("grp", F.col("run") * 1_000_000 + F.floor((inside - 1) / members))).drop("new", "run")


def label_parents(chunks: DataFrame, pattern: str, members: int | None = None) -> DataFrame:
    """Chunks take the last label declared at or before them (slide number, sheet name); chunks of a label are one group, or cut every few members."""
    own = F.nullif(F.regexp_extract("content", pattern, 1), F.lit(""))
    rows = chunks.withColumn("label", F.coalesce(F.last(own, ignorenulls=True).over(_in_doc()), F.lit("")))
    inside = F.row_number().over(Window.partitionBy("doc_id", "label").orderBy("idx"))
    part = F.floor((inside - 1) / members) if members else F.lit(0)
    rows = rows.withColumn("part", part)
    whole = Window.partitionBy("doc_id", "label", "part").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("parent_content", F.array_join(F.collect_list("content").over(whole), "\n\n")).drop("part")


def _with_parent(rows: DataFrame) -> DataFrame:
    whole = Window.partitionBy("doc_id", "grp").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("parent_content", F.array_join(F.collect_list("content").over(whole), "\n\n"))


def inherit_headings(chunks: DataFrame) -> DataFrame:
    """heading: the chunk's first heading line, else that of the chunk before."""
    own = F.nullif(F.regexp_extract("content", r"(?m)^#{1,6}\s+(.+)$", 1), F.lit(""))
    return chunks.withColumn("heading", F.last(own, ignorenulls=True).over(_in_doc()))


def neighbours(chunks: DataFrame, width: int = 1) -> DataFrame:
    """context: the chunks up to width places before and after, blank ones left out, joined by a blank line."""
    if width <= 0:
        return chunks.withColumn("context", F.lit(""))
    around = [F.collect_list(F.when(F.trim("content") != "", F.col("content"))).over(_in_doc().rowsBetween(a, b)) for a, b in ((-width, -1), (1, width))]
    return chunks.withColumn("context", F.array_join(F.concat(*around), "\n\n"))


def contextualize(chunks: DataFrame, summaries: DataFrame) -> DataFrame:
    """Chunks with a summary (chunk_id, summary) get it as a prefix."""
    rows = chunks.join(summaries, "chunk_id", "left")
    return rows.withColumn("content", F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("[context] "), "summary", F.lit("\n[content] "), "content")).otherwise(F.col("content"))).drop("summary")
