"""Edges that need libraries beyond Spark: PDF pages and text recognition (SRC-1, SRC-7).

Neither library is part of this environment; what lies behind the adapters is
tested on tables with the same columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition

SPANS = "doc_id long, pno int, block_no int, line_no int, span_no int, text string, font string, size double, x0 double, y0 double, x1 double, y1 double, origin_y double"


#: Filters that a page number can be held against before its page is opened.
TESTS: dict[str, Callable] = {
    "EqualTo": lambda p, v: p == v,
    "In": lambda p, v: p in v,
    "GreaterThan": lambda p, v: p > v,
    "GreaterThanOrEqual": lambda p, v: p >= v,
    "LessThan": lambda p, v: p < v,
    "LessThanOrEqual": lambda p, v: p <= v,
}


class PdfSpans(DataSource):
    """``spark.read.format("pdf_spans").load(path)``: the text spans of a file, a partition for each range of pages.

    Filters on ``pno`` are pushed down (SRC-2, with spark.sql.python.filterPushdown.enabled): other pages aren't opened.
    """

    @classmethod
    def name(cls) -> str:
        return "pdf_spans"

    def schema(self) -> str:
        return SPANS

    def reader(self, schema) -> DataSourceReader:
        return _PdfReader(self.options)


class _PdfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.doc_id, self.step = options["path"], int(options.get("docId", 0)), int(options.get("pagesPerTask", 16))
        self.wanted: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("pno",) and type(f).__name__ in TESTS:
                self.wanted.append((type(f).__name__, f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        import pymupdf

        with pymupdf.open(self.path) as doc:
            pages = [p for p in range(len(doc)) if all(TESTS[name](p, value) for name, value in self.wanted)]
        return [InputPartition(pages[a : a + self.step]) for a in range(0, len(pages), self.step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import pymupdf

        with pymupdf.open(self.path) as doc:
            for pno in partition.value:
                for b, block in enumerate(x for x in doc[pno].get_text("dict")["blocks"] if x["type"] == 0):
                    for n, line in enumerate(block["lines"]):
                        for k, s in enumerate(line["spans"]):
                            yield (self.doc_id, pno, b, n, k, s["text"], s["font"], float(s["size"]), *map(float, s["bbox"]), float(s["origin"][1]))


def recognised(pages: DataFrame, read: Callable[[bytes], str]) -> DataFrame:
    """SRC-7: ``text`` of pages without any, from their ``image`` by a recogniser; other pages stay as they are."""
    wanted = (F.trim(F.coalesce("text", F.lit(""))) == "") & (F.col("n_images") > 0)

    def run(batches):
        for b in batches:
            got = [read(i) if w and i else t for t, i, w in zip(b.column("text").to_pylist(), b.column("image").to_pylist(), b.column("_ocr").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.string()) if c == "text" else b.column(c) for c in b.schema.names], b.schema.names)

    marked = pages.withColumn("_ocr", wanted)
    return marked.mapInArrow(run, marked.schema)
