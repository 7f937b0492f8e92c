"""From raw documents to token counts: quality, line dedup, near-dedup, mixing, encoding.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, and run() writes
each one's result as Parquet and reads it again as the docs of the next. All but the last return the columns of
documents, and each works on all that the one before it kept. Columns of docs beyond those of documents are ignored,
whatever their names, and an empty table gives an empty one at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.byte_bpe import digests
from spanloom.llm.common import delete, discard, scratch_paths, table, written
from spanloom.llm.line_dedup import dedup_lines, row_key
from spanloom.llm.mixing import mix_sources
from spanloom.llm.quality import scored, train
from spanloom.llm.simhash import near_duplicates, sized

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def columns_of(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars as the text now has it."""
    return docs.select("doc_id", "text", "lang", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on those of docs that have labels, doesn't reject.

    Where nothing can be learnt (no positives, or no documents) every score is 0.5 and no document stays. Repeated rows
    have one score, so all or none of them stay; null and empty texts are scored as texts without features.
    """
    model = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the line chunks and the passages that earlier ones have.

    Rows equal in id and text are one document and keep the same lines; rows without an id come before others; null
    texts stay null, and texts of which nothing is left are empty.
    """
    return columns_of(dedup_lines(docs.select(*COLUMNS)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least doc_id (then row key) of each component of near copies (similarity 0.8 of five-word shingles), one of rows equal in id and text; rows without an id stay.

    Null, empty and blank texts are copies of each other. Of two rows with one id and different texts each is judged
    by its own text.
    """
    copies = written(near_duplicates(docs, shingle=5, similarity=0.8), "near-copies").where("doc_id is not null").withColumnRenamed("row_key", "_key")
    gone = copies.where("_key <> keep_key").select("_key").distinct()
    again = written(copies.where("_key = keep_key").groupBy("_key").count().where("count > 1").select("_key"), "near-again")
    keyed = docs.select(*COLUMNS, row_key(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("_key"))
    single = keyed.join(sized(written(gone.unionByName(again), "near-gone")), "_key", "left_anti").select(*COLUMNS)
    if again.isEmpty():
        return single
    repeated = keyed.join(sized(again), "_key", "left_semi").groupBy("_key").agg(F.min(F.struct(*COLUMNS)).alias("r"))
    return single.unionByName(repeated.select("r.*"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it.

    Documents without words go, as nothing of them can be taken. Rows with one id, and all rows without one, share a
    hash and with it their fate within a source; a null source is a source like any other.
    """
    mix = mix_sources(docs.select(*COLUMNS), carry=("text", "lang", "n_chars")).where("copies > 0")
    return mix.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of the mix, repeated ones included."""
    return digests(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("encoding", encoding)]

#: A classifier and a tokenizer are beyond SQL; tests hold the stages against brute force, one by one and together.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's scratch tables are deleted once its result is written, as nothing else reads them then."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        before = set(scratch_paths(spark))
        out = stage(spark, docs, sf_dir)
        left = [p for p in scratch_paths(spark) if p not in before]
        docs = written(out, f"pipeline-{name}")
        for path in left:
            delete(spark, path)
        if last is not None:
            discard(last)
        last = docs
    return docs
