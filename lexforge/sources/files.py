"""Corpora, mappings, judgements and vectors from files."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_punctuation


def text_files(spark: SparkSession, root: str) -> DataFrame:
    """(name, text) of every file below ``root``, one file a row, ASCII punctuation stripped."""
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    return rows.select(F.col("_metadata.file_name").alias("name"), strip_punctuation(F.col("value")).alias("text"))


def named_texts(files: DataFrame, mapping: DataFrame) -> DataFrame:
    """(text_id, text) of the files that ``mapping`` (name, text_id) names; the others are left out."""
    return files.join(mapping.select("name", "text_id"), "name").select("text_id", "text")


def id_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(name, text_id) from a CSV file with a header, its ids written as ObjectId(hex)."""
    rows = spark.read.csv(path, header=True)
    first, second = rows.columns[:2]
    return rows.select(F.col(second).alias("name"), F.regexp_extract(F.col(first), r"ObjectId\((.*)\)", 1).alias("text_id"))


def json_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of one JSON object of strings."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))


def test_collection(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, title, abstract, authors, body) of a JSON array of objects with the fields I, T, A, B and W."""
    rows = spark.read.schema("I string, T string, A string, B string, W string").json(path, multiLine=True)
    return rows.select(F.col("I").cast("long").alias("doc_id"), F.col("T").alias("title"), F.col("B").alias("abstract"), F.col("A").alias("authors"), F.col("W").alias("body"))


def judgements(spark: SparkSession, path: str) -> DataFrame:
    """(query, qnum, doc, relevance) of a JSON object: query text to a list of {qnum, dnum, rnum}. Queries without judgements keep one row of nulls."""
    whole = spark.read.text(path, wholetext=True)
    kind = "map<string,array<struct<qnum:long,dnum:long,rnum:int>>>"
    each = whole.select(F.explode(F.from_json("value", kind)).alias("query", "list")).select("query", F.explode_outer("list").alias("x"))
    return each.select("query", F.col("x.qnum").alias("qnum"), F.col("x.dnum").alias("doc"), F.col("x.rnum").alias("relevance"))


def relevance_lists(spark: SparkSession, path: str) -> DataFrame:
    """(query, doc, pos, target) of a JSON object: query text to a list of ids, best first; a repeated id keeps its first place."""
    whole = spark.read.text(path, wholetext=True)
    each = whole.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("query", "list"))
    rows = each.select("query", F.size("list").alias("n"), F.posexplode("list").alias("pos", "doc"))
    return rows.groupBy("query", "doc").agg(F.min("pos").alias("pos"), F.max("n").alias("n")).select("query", "doc", "pos", (F.col("n") - F.col("pos")).alias("target"))


def query_lines(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text) of the non-blank lines of a file; ids follow the order of the lines."""
    rows = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return rows.select(F.monotonically_increasing_id().alias("query_id"), F.col("value").alias("text"))


ARTICLE = "_id string, title string, abstract string, authors variant, body string, created string, journal string, references variant, url string, other variant"


def articles(spark: SparkSession, path: str) -> DataFrame:
    """Articles of JSON lines with ``authors`` as structs, whether typed as one string or as a list of objects."""
    rows = spark.read.schema(ARTICLE).json(path)
    listed = F.expr("try_variant_get(authors, '$', 'array<struct<firstname:string,lastname:string>>')")
    whole = F.expr("try_variant_get(authors, '$', 'string')")
    one = F.array(F.struct(F.lit(None).cast("string").alias("firstname"), whole.alias("lastname")))
    is_list = F.expr("schema_of_variant(authors)").startswith("ARRAY")
    return rows.withColumn("authors", F.when(is_list, listed).when(whole.isNotNull(), one))


OAI_RECORD = "metadata struct<arXiv:struct<id:string,title:string,abstract:string,created:string,updated:string,authors:struct<author:array<struct<keyname:string,forenames:string>>>,categories:string,doi:string,`journal-ref`:string>>"


def harvested(spark: SparkSession, path: str) -> DataFrame:
    """Articles of harvested XML pages, a row per record: id renamed, authors flattened, categories dropped, no references yet."""
    rows = spark.read.format("xml").option("rowTag", "record").schema(OAI_RECORD).load(path).select("metadata.arXiv.*")
    named = F.transform("authors.author", lambda a: F.struct(a["forenames"].alias("firstname"), a["keyname"].alias("lastname")))
    return rows.select(F.col("id").alias("arXiv_id"), "title", "abstract", "created", "updated", named.alias("authors"), "doi", F.col("journal-ref").alias("journal"), F.array().cast("array<string>").alias("references"))


def resumption_token(spark: SparkSession, path: str) -> str | None:
    """The token that continues a harvested page, null after the last one."""
    row = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r"<resumptionToken[^>]*>([^<]+)</resumptionToken>", 1).alias("t")).where("t <> ''").first()
    return row["t"] if row else None


def archived_texts(spark: SparkSession, root: str) -> DataFrame:
    """(archive, name, text) of the text files in tar archives, compressed or not; members are read one by one."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
                    for member in tar:
                        if member.isfile() and member.name.endswith(".txt"):
                            text = tar.extractfile(member).read().decode("utf-8", "replace")
                            yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([member.name]), pa.array([text])], ["archive", "name", "text"])

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tar*").load(root)
    return rows.select(F.col("_metadata.file_name").alias("archive"), "content").mapInArrow(unpacked, "archive string, name string, text string")


def matrix_rows(spark: SparkSession, path: str) -> DataFrame:
    """(id, v) of the rows of a .npy matrix on disk, read by slices."""
    import numpy as np

    shape = np.load(path, mmap_mode="r").shape

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = np.load(path, mmap_mode="r")
        for batch in batches:
            for start in batch.column(0).to_pylist():
                part = np.asarray(matrix[start : start + 4096], np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]), pa.array(part.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + len(part))), lists], ["id", "v"])

    return spark.range(0, shape[0], 4096).mapInArrow(rows, "id long, v array<float>")


def size_on_disk(spark: SparkSession, path: str, source: str = "parquet") -> int:
    """Bytes of the files of a table."""
    files = spark.read.format(source).load(path).select("_metadata.file_path", "_metadata.file_size").distinct()
    return files.agg(F.coalesce(F.sum("file_size"), F.lit(0))).first()[0]


def refuse_above(spark: SparkSession, path: str, most: int = 100_000_000_000) -> None:
    """An error if a table is larger than ``most`` bytes."""
    if (size := size_on_disk(spark, path)) > most:
        raise ValueError(f"{path} has {size} bytes, more than {most}")
