"""An index kept up to date as documents arrive."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import best_text
from ..operators.index import weighted_terms
from ..session import by_shuffle, cut


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:  # the first batch finds no table
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def unindexed(documents: DataFrame, postings: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents that have no posting yet; the batch counterpart of the stream."""
    return documents.join(postings.select(key).distinct(), key, "left_anti")


def to_index(papers: DataFrame) -> DataFrame:
    """(paper_id, text) of the papers that lack a vector or the mark of the index: the body, or else the abstract. The conditions are read in the scan."""
    lacking = F.col("other.para_vec").isNull() | F.col("other.tfidf_indexed").isNull()
    return papers.where(lacking).select("paper_id", best_text(F.col("body"), F.col("abstract")).alias("text"))


def add_batch(target: str, key: str = "doc_id"):
    """A writer for foreachBatch: postings of each batch's new documents, in a folder per batch.

    A batch that runs again overwrites its own folders, so a restart neither loses nor doubles
    postings; a document that an earlier batch has is left out. Which documents are in is told by
    a folder of keys beside the postings, a row per document, so the postings aren't read again.
    """

    def write(batch: DataFrame, number: int) -> None:
        kind = batch.schema[key].dataType.simpleString()
        known = _read(batch.sparkSession, f"{target}/keys", f"{key} {kind}, batch int").where(F.col("batch") != number)
        fresh = cut(batch.dropDuplicates([key]).join(by_shuffle(known.select(key)), key, "left_anti"))
        weighted_terms(fresh, key).write.mode("overwrite").parquet(f"{target}/postings/batch={number}")
        fresh.select(key).write.mode("overwrite").parquet(f"{target}/keys/batch={number}")

    return write


def index_stream(documents: DataFrame, target: str, checkpoint: str, key: str = "doc_id"):
    """Start indexing a stream of (key, text) into ``target``; ends when the available data are in."""
    return documents.writeStream.foreachBatch(add_batch(target, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_folder(spark: SparkSession, folder: str, schema: str, files_at_once: int = 1) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def running_df(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """A stream of (term, df) counters, for the update mode; each document must arrive once."""
    from ..functions.text import words

    return documents.select(F.explode(F.array_distinct(words(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def recent_documents(events: DataFrame, late: str = "2 days", window: str = "1 day") -> DataFrame:
    """A stream of (user_id, window, n, last) of user events by event time, late ones up to ``late`` included."""
    return events.withWatermark("ts", late).groupBy("user_id", F.window("ts", window).alias("window")).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("ts", "event_id")).alias("last"))
