"""Keep the lexicon of a growing corpus: each word's repetitions per source, from new files only.

    python -m jobs.lexicon --documents PATH --output PATH --checkpoint PATH [--config FILE]

Documents (text, and columns for language and source) arrive as Parquet files. A file stream takes those that no earlier run has
taken and ends when there are no more. Words are folded as labels are (composed, one kind of apostrophe, lower case),
counted per (language, source, word) and added to the counts so far. Then the lexicon is written, one folder per language:

    lang, word, n, n_sources, least, most, mean    (repetitions in all, sources that have the word, repetitions per source)

Safe to run again. The counts live in two tables under CHECKPOINT/counts, written in turn: batch k reads the one of batch k - 1 and
replaces the other, so a batch that is taken up again after a failure starts from the same counts and counts nothing twice. The
stream's own checkpoint under CHECKPOINT/stream says which files were taken. The lexicon follows from the counts alone; a run without new
files writes the same one, and mends one that an interrupted run has left in pieces. A null text has no words; a null language or source
is a language or source of its own. A file that was taken isn't read again when it changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, log, observed
from tessera.functions.columns import fold_word
from tessera.session import ensure_worker_path

COUNTS = "lang string, source string, word string, n long, batch long"


def words(text: Column) -> Column:
    """Folded words: what stands between blanks, without the marks around it."""
    blank, edge = r"[\x20\x09-\x0D]+", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
    return F.filter(F.transform(F.split(fold_word(text), blank), lambda w: F.regexp_replace(w, edge, "")), lambda w: w != "")


def counted(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """n per (lang, source, word). Tasks add up before the shuffle, so a frequent word or a large source is no task's burden."""
    each = docs.select(F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.explode(words(F.col(text))).alias("word"))
    return each.groupBy("lang", "source", "word").agg(F.count("*").alias("n"))


def lexicon(counts: DataFrame) -> DataFrame:
    n = F.sum("n").alias("n")
    return counts.groupBy("lang", "word").agg(n, F.count("*").alias("n_sources"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"))


def turn(checkpoint: str, batch: int) -> str:
    return f"{checkpoint}/counts/turn={batch % 2}"


def latest(spark: SparkSession, checkpoint: str) -> tuple[DataFrame, int]:
    """The counts of the last batch that was written, and its number; none and -1 before the first one."""
    both = spark.read.schema(f"{COUNTS}, turn int").parquet(f"{checkpoint}/counts")
    last = both.agg(F.max("batch")).first()[0]
    return both.where(F.col("batch") == last).drop("turn"), -1 if last is None else last


def file_or_folder(path: str) -> str:
    """The path as a pattern that matches it alone; a stream takes a single file only by a pattern."""
    top, _, name = path.rstrip("/").rpartition("/")
    return f"{top}/{{{name}}}" if top else f"{{{name}}}"


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, text: str = "text", lang: str = "lang", source: str = "source", files_per_batch: int = 1000) -> dict:
    """Take what is new in documents and write the lexicon to output. Returns what was read and written."""
    ensure_worker_path(spark)
    said = {"batches": 0, "rows_read": 0, "texts_missing": 0}

    def batch(docs: DataFrame, k: int) -> None:
        session = docs.sparkSession
        docs, seen = observed(docs, rows_read=F.count(F.lit(1)), texts_missing=F.count(F.when(F.col(text).isNull(), 1)))
        total = counted(docs, text, lang, source)
        if k:
            total = total.unionByName(session.read.schema(COUNTS).parquet(turn(checkpoint, k - 1)).drop("batch"))
        total = total.groupBy("lang", "source", "word").agg(F.sum("n").alias("n")).withColumn("batch", F.lit(k).cast("long"))
        total.write.mode("overwrite").parquet(turn(checkpoint, k))
        got = seen()
        said["batches"] += 1
        for x in ("rows_read", "texts_missing"):
            said[x] += got[x]
        log.info("batch %d: read %d rows of %s, %d without a text", k, got["rows_read"], documents, got["texts_missing"])

    # So that there is a folder of counts, even before the first batch.
    spark.createDataFrame([], f"{COUNTS}, turn int").write.mode("append").partitionBy("turn").parquet(f"{checkpoint}/counts")
    stream = spark.readStream.schema(spark.read.parquet(documents).schema).option("maxFilesPerTrigger", files_per_batch).parquet(file_or_folder(documents))
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()

    counts, last = latest(spark, checkpoint)
    rows = lexicon(counts).withColumn("language", F.coalesce(F.when(F.col("lang") != "", F.col("lang")), F.lit("none")))
    rows, wrote = observed(rows, words_written=F.count(F.lit(1)), repetitions=F.coalesce(F.sum("n"), F.lit(0)))
    rows.hint("rebalance", "language").write.partitionBy("language").mode("overwrite").option("partitionOverwriteMode", "static").parquet(output)
    said |= {"last_batch": last, **wrote()}
    log.info("wrote %d words with %d repetitions to %s", said["words_written"], said["repetitions"], output)
    return said


if __name__ == "__main__":
    command_line(run, {"documents": "Parquet files of documents, a folder that grows", "output": "folder of the lexicon", "checkpoint": "folder of the stream's checkpoint and the counts"}, "lexicon.yaml", __doc__)
