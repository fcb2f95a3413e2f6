import io
import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.sources import files, sinks


def test_text_files_and_mapping(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_text("a-b, c!\nd")
    (tmp_path / "in/deep/b.txt").write_text("x_y")
    (tmp_path / "in/unmapped.txt").write_text("z")
    (tmp_path / "map.csv").write_text("_id,file\nObjectId(4b3d),a.txt\nObjectId(4b3e),b.txt\n")
    rows = files.named_texts(files.text_files(spark, str(tmp_path / "in")), files.id_mapping(spark, str(tmp_path / "map.csv")))
    assert sorted(map(tuple, rows.collect())) == [("4b3d", "ab c\nd"), ("4b3e", "xy")]


def test_json_sources(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"x": "1", "y": "2"}, indent=1))
    assert sorted(map(tuple, files.json_mapping(spark, str(tmp_path / "m.json")).collect())) == [("x", "1"), ("y", "2")]
    (tmp_path / "c.json").write_text(json.dumps([{"I": 1, "T": "t", "A": "a", "B": "b", "W": "w"}, {"I": 2}], indent=1))
    assert [tuple(r) for r in files.test_collection(spark, str(tmp_path / "c.json")).orderBy("doc_id").collect()] == [(1, "t", "b", "a", "w"), (2, None, None, None, None)]
    (tmp_path / "q.json").write_text(json.dumps({"q one": [{"qnum": 1, "dnum": 5, "rnum": 2}], "none": []}))
    assert sorted(map(tuple, files.judgements(spark, str(tmp_path / "q.json")).collect()), key=str) == [("none", None, None, None), ("q one", 1, 5, 2)]
    (tmp_path / "r.json").write_text(json.dumps({"q": ["best", "next", "best", "last"], "e": []}))
    assert sorted(map(tuple, files.relevance_lists(spark, str(tmp_path / "r.json")).collect())) == [("q", "best", 0, 4), ("q", "last", 3, 1), ("q", "next", 1, 3)]
    (tmp_path / "q.txt").write_text("first query\n\n second\n")
    assert [r["text"] for r in files.query_lines(spark, str(tmp_path / "q.txt")).orderBy("query_id").collect()] == ["first query", " second"]


def test_articles_with_either_kind_of_authors(spark, tmp_path):
    rows = [{"_id": "1", "title": "t", "authors": [{"firstname": "A", "lastname": "B"}]}, {"_id": "2", "authors": "Whole Name"}, {"_id": "3"}]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, rows)))
    found = {r["_id"]: r["authors"] and [tuple(a) for a in r["authors"]] for r in files.articles(spark, str(tmp_path / "a.json")).select("_id", "authors").collect()}
    assert found == {"1": [("A", "B")], "2": [(None, "Whole Name")], "3": None}


PAGE = """<OAI-PMH><ListRecords><record><metadata><arXiv><id>0704.1</id><title>One</title><abstract>x</abstract><created>2007-04-01</created>
<authors><author><keyname>Ho</keyname><forenames>A. B.</forenames></author><author><keyname>Li</keyname></author></authors><categories>cs</categories></arXiv></metadata></record>
<record><metadata><arXiv><id>0704.2</id><title>Two</title></arXiv></metadata></record>{}</ListRecords></OAI-PMH>"""


def test_harvested_pages(spark, tmp_path):
    (tmp_path / "1.xml").write_text(PAGE.format('<resumptionToken cursor="0">abc|1001</resumptionToken>'))
    rows = files.harvested(spark, str(tmp_path / "1.xml")).orderBy("arXiv_id").collect()
    assert [tuple(a) for a in rows[0]["authors"]] == [("A. B.", "Ho"), (None, "Li")] and rows[1]["authors"] is None
    assert "categories" not in rows[0].asDict() and rows[0]["references"] == []
    assert files.resumption_token(spark, str(tmp_path / "1.xml")) == "abc|1001"
    (tmp_path / "2.xml").write_text(PAGE.format("<resumptionToken/>"))
    assert files.resumption_token(spark, str(tmp_path / "2.xml")) is None


@pytest.mark.parametrize("mode", ["w", "w:gz"])
def test_archives(spark, tmp_path, mode):
    with tarfile.open(tmp_path / ("a.tar" + ".gz" * (mode == "w:gz")), mode) as tar:
        for name, content in (("x/1.txt", b"one"), ("2.txt", "zwei ä".encode()), ("3.pdf", b"%PDF")):
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
    assert sorted((r["name"], r["text"]) for r in files.archived_texts(spark, str(tmp_path)).collect()) == [("2.txt", "zwei ä"), ("x/1.txt", "one")]


def test_matrix_and_size_guard(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.save(tmp_path / "m.npy", x)
    assert [r["v"] for r in files.matrix_rows(spark, str(tmp_path / "m.npy")).orderBy("id").collect()] == x.tolist()
    spark.range(10).write.parquet(str(tmp_path / "t"))
    assert files.size_on_disk(spark, str(tmp_path / "t")) > 0
    files.refuse_above(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        files.refuse_above(spark, str(tmp_path / "t"), 1)


def test_sinks(spark, tmp_path):
    ranked = spark.createDataFrame([(1, 2, "b" * 24, 0.25), (1, 1, "short", 0.5), (2, 1, "c" * 24, 0.1)], "query_id long, rank int, doc string, score double")
    made = {r["query_id"]: json.loads(r["json"]) for r in sinks.envelope(ranked).collect()}
    assert made[1] == {"errno": 0, "errstr": "", "numResults": 2, "results": [{"_id": "short", "score": 0.5}, {"_id": "b" * 24, "score": 0.25}]}
    titles = spark.createDataFrame([("b" * 24, "A \n title"), ("short", "no")], "text_id string, title string")
    lines = {r["doc"]: r["line"] for r in sinks.with_titles(ranked, titles).select("doc", sinks.result_line(F.col("rank"), F.col("score"), F.col("title")).alias("line")).collect()}
    assert lines["b" * 24] == "  2  0.25000  A title" and lines["short"] == "  1  0.50000  "
    judged = ranked.select("query_id", "doc", F.lit(5).alias("relevance"), "score")
    sinks.write_judged(judged, str(tmp_path / "tsv"))
    assert "1\tshort\t5\t0.5000000000000000" in {r["value"] for r in spark.read.text(str(tmp_path / "tsv")).collect()}
    postings = spark.createDataFrame([("b", 1, 0.1), ("a", 2, 0.3), ("a", 1, 0.9)], "term string, doc_id long, lnc double")
    sinks.write_postings(postings.coalesce(1), str(tmp_path / "post"), "lnc")
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "post")).orderBy("term", F.desc("lnc")).collect()] == [("a", 1, 0.9), ("a", 2, 0.3), ("b", 1, 0.1)]


def test_judged_lines_are_read_back_file_by_file(spark, tmp_path, monkeypatch):
    """Sixteen places however small a score is, gaps, one file at a time and none at the end."""
    import pyarrow as pa

    scores = [0.25, 1 / 3, -0.5, 0.0, 7.7e-7, 1e-20, 12.5, 1e18, float("nan"), None]
    names, written, plain_write = ["query_id", "doc", "relevance", "score"], [], sinks.csv.write_csv

    def watched(table, path, options):
        plain_write(table, path, options)
        assert len(list(tmp_path.iterdir())) == 1
        written.extend(open(path).read().splitlines())

    monkeypatch.setattr(sinks.csv, "write_csv", watched)
    monkeypatch.setattr(sinks.tempfile, "tempdir", str(tmp_path))
    monkeypatch.setattr(sinks, "PIECE", 4)
    batches = [pa.RecordBatch.from_arrays([pa.array([i, i]), pa.array([7, None]), pa.array([5, 1], pa.int32()), pa.array([x, x], pa.float64())], names) for i, x in enumerate(scores)]
    out = pa.Table.from_batches(sinks._reread(iter(batches)))
    assert written[::2] == [f"{i}\t7\t5\t{'' if x is None else f'{x:.16f}'}" for i, x in enumerate(scores)] and not list(tmp_path.iterdir())
    assert out["query_id"].to_pylist() == [i for i in range(10) for _ in "ab"] and out["doc"].to_pylist() == [7, None] * 10
    assert out["score"].to_pylist()[:-2] == pytest.approx([x for x in scores[:-1] for _ in "ab"], abs=1e-16, nan_ok=True) and out["score"].null_count == 2


def test_judged_rankings_leave_no_lines(spark):
    from pathlib import Path

    from lexforge.plans import files as plans
    from lexforge.session import shared_folder

    def lines():
        return {p for p in Path(shared_folder(spark).removeprefix("file:")).rglob("*") if p.suffix in (".csv", ".tsv")}

    before = lines()
    assert plans.files_judged_rankings(spark, "/root/testdata/sf0.001").count()
    assert lines() == before
