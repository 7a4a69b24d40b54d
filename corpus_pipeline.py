"""The corpus pipeline: five stages over ``documents``, each calling one operator of quire.llm.

Every stage but the last returns the columns of ``documents``; the last returns
packed pieces. Stages write nothing themselves: ``run`` writes each result as
Parquet in the shared folder and rereads it as the next stage's input.

Rows: the toxicity stage drops texts scored 0.5 or more, the near-duplicate stage
all but one document of each component over links of similarity 0.80 or more of
5-word shingle sets (op7's query links at 0.85); the substring stage keeps every row with
the words that are left and the white space between them, one space where a
passage went; the mixing stage keeps the documents the mixture takes words from,
with the words taken: whole texts as they are, parts with single spaces, the second
pass over a source on a new line behind the first. Reruns take the same words. The
packing stage returns a row for each piece. Nulls, empty texts, very
long texts, ties, repeated rows and empty tables behave as each operator says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm import common as C
from quire.llm.minhash import near_duplicates
from quire.llm.mixing import mix
from quire.llm.packing import pack_documents
from quire.llm.substring import remove_repeats
from quire.llm.toxicity import score

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    rejected = score(docs.select("doc_id", "text"), labels).where("score >= 0.5").select("doc_id").distinct()
    return docs.select(COLUMNS).join(rejected.hint("merge"), "doc_id", "left_anti").select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    dropped = near_duplicates(docs.select("doc_id", "text"), num=80, den=100).where("not kept").select("doc_id").distinct()
    return docs.select(COLUMNS).join(dropped.hint("merge"), "doc_id", "left_anti").select(COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = remove_repeats(docs.select(COLUMNS), spacing=True)
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select(COLUMNS).withColumn("_h", F.xxhash64("text"))
    m = mix(rows)
    parts = m.taken().groupBy("sid", "doc_id", "h", "start").agg(F.sort_array(F.collect_list(F.struct("first", "n", "uses"))).alias("parts"))
    # rows alike in id, text and source are copies: the k-th one takes what the k-th place in the source's stream gives
    copies = parts.groupBy("sid", "doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("start", "parts"))).alias("copies"))
    copies = copies.join(m.sources.select("sid", F.col("source").alias("_s")), "sid").select(F.col("doc_id").alias("_d"), "h", "_s", "copies")
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("h")) & F.col("source").eqNullSafe(F.col("_s"))
    joined = rows.join(copies.hint("merge"), same)
    k = F.row_number().over(Window.partitionBy("doc_id", "_h", "source").orderBy("lang", "n_chars"))
    joined = joined.withColumn("_k", k).where("_k <= size(copies)").withColumn("parts", F.expr("element_at(copies, _k).parts"))
    joined = joined.withColumn("words", F.array_remove(F.split(F.translate("text", "\t\n\x0b\x0c\r", "     "), " "), ""))

    def taken(k: int) -> Column:
        """The words of the k-th pass; a text taken whole keeps its lines and spaces."""
        some = f"filter(parts, p -> p.uses >= {k})"
        cut = F.array_join(F.flatten(F.expr(f"transform({some}, p -> slice(words, int(p.first + 1), int(p.n)))")), " ")
        return F.when(F.expr(f"aggregate({some}, 0L, (a, p) -> a + p.n) = size(words)"), F.col("text")).when(F.expr(f"size({some}) > 0"), cut)

    text = F.concat_ws("\n", taken(1), taken(2))
    return joined.select("doc_id", text.alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixing), ("packing", packing)]

#: Nearest neighbours and a tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = C.written(stage(spark, docs, sf_dir))
    return docs
