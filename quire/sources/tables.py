"""Files of the pipeline as tables: dumps, ledgers, glossaries, uploads and their writers (SRC-8 to SRC-16, SNK-2 to SNK-7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators.joins import present

DUMP = "pages array<struct<pno:int,paragraphs:array<struct<pid:array<int>,col:int,y0:double,y1:double,x0:double,x1:double,heading:boolean,src:string,text:string>>>>"
JOB = "id string, pdf_path string, pdf_name string, output_dir string, provider string, model string, pages string, bilingual boolean, appendix boolean, status string, created_at long, ended_at long, timeout_at long, progress double, phase string, error string, note string, output_paths array<string>, stats map<string,int>, failed_paragraphs int"
#: Layout labels that are known; others are dropped (SRC-9).
LAYOUT_LABELS = ("title", "section", "header", "footer", "picture", "caption", "formula")


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11: a translation dump, one row a paragraph; ``ord`` counts rows of a page."""
    pages = spark.read.schema(DUMP).option("multiLine", True).json(path).select(F.inline("pages"))
    return pages.select("pno", F.posexplode("paragraphs").alias("ord", "p")).select("pno", "ord", F.element_at("p.pid", 2).alias("seq"), "p.col", "p.x0", "p.y0", "p.x1", "p.y1", "p.heading", "p.src", "p.text")


def parsed_dumps(rows: DataFrame, json: str) -> DataFrame:
    """SRC-11, JSN-1: dumps that stand as JSON in a column, one row a paragraph beside the other columns."""
    rest = [c for c in rows.columns if c != json]
    pages = rows.select(*rest, F.inline(F.from_json(json, f"pages {DUMP.split(' ', 1)[1]}")["pages"]))
    return pages.select(*rest, "pno", F.posexplode("paragraphs").alias("ord", "p")).select(*rest, "pno", "ord", F.element_at("p.pid", 2).alias("seq"), "p.col", "p.x0", "p.y0", "p.x1", "p.y1", "p.heading", "p.src", "p.text")


def dump_json(rows: DataFrame) -> DataFrame:
    """SNK-4: (doc_id, json) in the form that read_dump reads."""
    para = F.struct(F.array("pno", "seq").alias("pid"), *[c for c in ("col", "y0", "y1", "x0", "x1", "heading") if c in rows.columns], "src", "text")
    page = rows.groupBy("doc_id", "pno").agg(F.array_sort(F.collect_list(F.struct("seq", para.alias("p")))).alias("s"))
    by = page.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pno", F.transform("s", lambda x: x["p"]).alias("paragraphs")))).alias("pages"))
    return by.select("doc_id", F.to_json(F.struct("pages")).alias("json"))


def term_count(text: Column) -> Column:
    """AGG-9: lines of a glossary that name a term."""
    return F.size(F.filter(F.split(text, "\n"), X.glossary_term))


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """SRC-12: (text, terms), the whole file without outer white space."""
    t = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\\s+|\\s+$", "").alias("text"))
    return t.withColumn("terms", term_count(F.col("text")))


def read_ledger(spark: SparkSession, path: str, last: int = 200) -> DataFrame:
    """SRC-13: jobs with an id and a path, the last ones in the order of the file."""
    jobs = spark.read.schema(f"version int, jobs array<struct<{', '.join(f.replace(' ', ':', 1) for f in _fields(JOB))}>>").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    rows = jobs.select(F.posexplode("jobs").alias("seq", "j")).select("seq", "j.*").where("id is not null and pdf_path is not null")
    return rows.orderBy(F.desc("seq")).limit(last)


def _fields(schema: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema + ","):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(schema[at:i].strip())
            at = i + 1
    return out


def layout_boxes(raw: DataFrame) -> DataFrame:
    """SRC-9: boxes with a known label and a proper rectangle."""
    return raw.where(F.col("label").isin(*LAYOUT_LABELS) & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))


def image_rects(images: DataFrame, least: float, distinct: bool = False) -> DataFrame:
    """SRC-10: images with both sides beyond ``least``; with ``distinct`` one for each rounded place and size."""
    some = images.where((F.col("x1") - F.col("x0") > least) & (F.col("y1") - F.col("y0") > least))
    if not distinct:
        return some
    keyed = some.withColumns({"_x": F.round("x0"), "_y": F.round("y0"), "_w": F.round(F.col("x1") - F.col("x0")), "_h": F.round(F.col("y1") - F.col("y0"))})
    return keyed.dropDuplicates(["doc_id", "pno", "_x", "_y", "_w", "_h"]).drop("_x", "_y", "_w", "_h")


def protected_regions(images: DataFrame, vectors: DataFrame, tables: DataFrame) -> DataFrame:
    """SRC-19, SET-5, JOIN-7: images (0.92), vector regions not 0.6 under a table (0.80) and tables (0.55)."""
    from quire.operators import joins as J

    cols = ["doc_id", "pno", "x0", "y0", "x1", "y1"]
    t = tables.select("doc_id", "pno", *[F.col(c).alias(f"r_{c}") for c in cols[2:]])
    free = J.touching(vectors.select(*cols), t, J.covers(0.6), "left_anti")
    part = lambda d, share, kind: d.select(*cols, F.lit(share).alias("threshold"), F.lit(kind).alias("kind"))
    return part(images, 0.92, "img").unionByName(part(free, 0.80, "vec")).unionByName(part(tables, 0.55, "table"))


def uploads(files: DataFrame, most: int = 100 * 2**20) -> DataFrame:
    """SRC-16: PDF files within the size, under safe names; equal names get -1, -2 ... in order of ``ord``."""
    f = files.where((F.substring("content", 1, 5) == F.lit(b"%PDF-")) & (F.octet_length("content") <= most)).withColumn("safe", X.safe_name(F.col("name")))
    k = F.row_number().over(Window.partitionBy("safe").orderBy("ord")) - 1
    stem, ext = F.regexp_replace("safe", "\\.[^.]*$", ""), F.regexp_extract("safe", "(\\.[^.]*)$", 1)
    return f.withColumn("_k", k).withColumn("stored", F.when(F.col("_k") == 0, F.col("safe")).otherwise(F.concat(stem, F.lit("-"), F.col("_k").cast("string"), ext))).drop("_k")


def heading_level(size: Column) -> Column:
    return F.when(size >= 17, "# ").when(size >= 13, "## ").otherwise("### ")


def markdown(paragraphs: DataFrame, note: str = "> 参考文献保持原文。") -> DataFrame:
    """SNK-2: (doc_id, markdown). ``paragraphs`` has pno, seq, text, translated, size and the flags.

    Formulas leave a mark, references one note for all, skipped ones their source; WIN-6 is the note.
    """
    w = Window.partitionBy("doc_id", "is_ref").orderBy("pno", "seq")
    body = X.placeholders_to_mark(F.col("translated"))
    part = (
        F.when(F.col("is_math"), F.lit(X.FORMULA_MARK))
        .when(F.col("is_ref"), F.when(F.col("_k") == 1, F.lit(note)))
        .when(F.col("is_skip"), F.col("text"))
        .when(F.col("is_heading"), F.concat(heading_level(F.col("size")), body))
        .otherwise(body)
    )
    rows = paragraphs.withColumn("_k", F.row_number().over(w)).withColumn("part", part).where("part is not null")
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pno", "seq", "part"))), lambda x: x["part"]), "\n\n").alias("markdown"))


def bilingual(paragraphs: DataFrame) -> DataFrame:
    """SNK-3: (doc_id, markdown) of source and translation, for what can be translated."""
    raw = X.collapse(F.col("text"))
    out = F.coalesce(present(F.col("translated")), F.concat(F.lit(X.FAILED_MARK), raw))
    rows = paragraphs.where(~F.col("is_math") & ~F.col("is_ref") & ~F.col("is_skip") & (F.length(raw) > 0))
    rows = rows.withColumn("part", F.concat(raw, F.lit("\n\n> "), X.placeholders_to_mark(out)))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pno", "seq", "part"))), lambda x: x["part"]), "\n\n").alias("markdown"))


def whitelisted(wanted: DataFrame, jobs: DataFrame) -> DataFrame:
    """SNK-7: requested (id, path) rows whose path is an output of the job."""
    paths = jobs.select("id", F.explode("output_paths").alias("path"))
    return wanted.join(paths, ["id", "path"], "left_semi")


def write_ledger(jobs: DataFrame, path: str, last: int = 200) -> None:
    """SNK-6: the last jobs in the order of ``seq`` as one JSON document {version, jobs} that read_ledger reads.

    It is written beside the old one and then takes its place, so readers see the one or the other.
    """
    spark = jobs.sparkSession
    fields = [f.split()[0] for f in _fields(JOB)]
    keep = jobs.orderBy(F.desc("seq")).limit(last)
    rows = F.array_sort(F.collect_list(F.struct("seq", F.struct(*[c for c in fields if c in jobs.columns]).alias("j"))))
    document = keep.agg(F.to_json(F.struct(F.lit(1).alias("version"), F.transform(rows, lambda x: x["j"]).alias("jobs"))).alias("value"))
    beside = f"{path}.tmp"
    document.coalesce(1).write.mode("overwrite").text(beside)
    jvm = spark._jvm
    new = jvm.org.apache.hadoop.fs.Path(beside)
    fs = new.getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(new) if f.getPath().getName().startswith("part-"))
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(part), context.makeQualified(jvm.org.apache.hadoop.fs.Path(path)), options)
    fs.delete(new, True)


def write_progress(records: DataFrame, path: str, checkpoint: str, seconds: float = 0.5):
    """SNK-5: a stream's progress rows as JSON files, at most one write each ``seconds``."""
    return records.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=f"{int(seconds * 1000)} milliseconds").start()
