"""Papers as units of text: bodies, titles, abstracts and author lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, by_shuffle, cut

#: The type codes of units.
TYPES = {"fulltext": 1, "title": 2, "abstract": 3, "authors": 4, "wiki": 5}


def one_row_per_paper(papers: DataFrame, *columns: str) -> DataFrame:
    """The named columns of each paper_id's first harvest; rows without an id drop out.

    Only the keys of papers that come again are grouped and moved: the other rows stay where they
    were read, texts and all. A null time counts as the latest; rows of one time are told apart by a
    hash of the columns.
    """
    at = F.coalesce("harvested_at", F.lit("9999-12-31").cast("timestamp_ntz")).cast("timestamp_ntz")
    rows = papers.where(F.col("paper_id").isNotNull())
    times = rows.groupBy("paper_id", at.alias("_at")).agg(F.count(F.lit(1)).alias("_n")).groupBy("paper_id").agg(F.sum("_n").alias("_times"), F.min(F.struct("_at", "_n")).alias("_first"))
    again = broadcast_if_small(times.where("_times > 1").select("paper_id", "_first"))
    joined = rows.select("paper_id", *columns, at.alias("_at")).join(again, "paper_id", "left")
    tied = F.col("_first").isNotNull() & (F.col("_first._n") > 1)
    firsts = joined.where(F.col("_first").isNull() | (F.col("_at") == F.col("_first._at")))
    if again.where("_first._n > 1").isEmpty():
        return firsts.select("paper_id", *columns)
    value = F.struct(*columns)
    chosen = firsts.where(tied).groupBy("paper_id").agg(F.min_by(value, F.xxhash64(value)).alias("v")).select("paper_id", "v.*")
    return firsts.where(~tied).select("paper_id", *columns).unionByName(chosen)


def flat_authors(authors: Column) -> Column:
    """Names as text: the parts of a name by one space, names by two."""
    return F.array_join(F.transform(authors, lambda a: F.concat_ws(" ", a["firstname"], a["lastname"])), "  ")


def sub_documents(papers: DataFrame) -> DataFrame:
    """(text_id, doc_type, text, parent): a unit for each field of a paper that is long enough.

    Bodies need a character, titles and abstracts three, author lists one. ``parent`` is null for
    bodies. Null fields give no unit.
    """
    one = one_row_per_paper(papers, "title", "abstract", "authors", "body")
    fields = [("body", 1, "", F.col("body"), 1), ("title", 2, "title_", F.col("title"), 3), ("abstract", 3, "abstract_", F.col("abstract"), 3), ("authors", 4, "authors_", flat_authors(F.col("authors")), 1)]
    units = F.array(*[F.struct(F.concat(F.lit(head), F.col("paper_id")).alias("text_id"), F.lit(code).cast("short").alias("doc_type"), text.alias("text"), (F.lit(None).cast("string") if code == 1 else F.col("paper_id")).alias("parent"), F.lit(least).alias("least")) for _, code, head, text, least in fields])
    return one.select(F.explode(units).alias("u")).select("u.*").where(F.length("text") >= F.col("least")).drop("least")


def parse_text_id(text_id: Column) -> tuple[Column, Column]:
    """Type code and parent's id out of a unit's id: the part before its first '_', the part after its last."""
    head = F.substring_index(text_id, "_", 1)
    code = F.lit(None).cast("int")
    for name, number in TYPES.items():
        code = F.when(head == name, number).otherwise(code)
    return code, F.substring_index(text_id, "_", -1)


#: Indexed parents up to which their ids are sent to the units, which then are read once and not moved.
SENT_PARENTS = 200_000


def with_indexed_parent(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The units whose parent is indexed or that need none, and the orphans."""
    parents = cut(units.where("doc_type = 1").select(F.col("text_id").alias("parent")).distinct())
    if parents.count() <= SENT_PARENTS:
        known = units.join(F.broadcast(parents.withColumn("_hit", F.lit(True))), "parent", "left").select(*units.columns, "_hit")
        return known.where("doc_type = 1 or _hit").drop("_hit"), known.where("doc_type <> 1 and _hit is null").drop("_hit")
    child = units.where("doc_type <> 1")
    kept = units.where("doc_type = 1").unionByName(child.join(by_shuffle(parents), "parent", "left_semi").select(*units.columns))
    return kept, child.join(by_shuffle(parents), "parent", "left_anti").select(*units.columns)


def best_text(body: Column, abstract: Column) -> Column:
    """The body, or the abstract where there is none."""
    return F.coalesce(body, abstract)
