import json
import threading
import urllib.error
import urllib.request

from pyspark.sql import functions as F

from lexforge.operators import accounts, corpus
from lexforge.operators.cache import ResultCache
from lexforge.service import SearchService, serve
from lexforge.streaming import index_stream
from lexforge.operators.index import log_weights, term_counts

PAPER = "paper_id string, title string, abstract string, authors array<struct<firstname:string,lastname:string>>, body string, harvested_at timestamp_ntz, text string, parent string"


def test_sub_documents(spark):
    rows = [("p", "Title", "ab", [("A", "B"), (None, "C")], "body", None, None, None), ("p", "Title", "ab", [("A", "B"), (None, "C")], "body", None, None, None), ("q", "Orphan", "long enough", [], None, None, None, None), (None, "t t t", "abc", None, "x", None, None, None), ("r", None, None, [None], "", None, None, None)]
    kept, orphans = corpus.with_indexed_parent(corpus.sub_documents(spark.createDataFrame(rows, PAPER)))
    assert sorted((r["text_id"], r["doc_type"], r["text"], r["parent"]) for r in kept.collect()) == [("authors_p", 4, "A B  C", "p"), ("p", 1, "body", None), ("title_p", 2, "Title", "p")]
    assert sorted(r["text_id"] for r in orphans.collect()) == ["abstract_q", "title_q"]
    code, parent = corpus.parse_text_id(F.col("text_id"))
    assert sorted((r[0], r[1]) for r in kept.where("parent is not null").select(code, parent).collect()) == [(2, "p"), (4, "p")]


def test_cache():
    now = [0.0]
    cache = ResultCache(10, 3, lambda: now[0])
    cache.put("k", 1, most=5, offset=0)
    assert cache.get("k") == 1 and cache.get("k", most=5) == 1 and cache.get("k", most=6) is None and cache.get("k", other=1) is None
    now[0] = 11
    assert cache.get("k") is None and "k" not in cache.entries
    cache.put("a", 1, lifetime=1)
    now[0] = 20
    for i in range(3):
        cache.put(i, i)
    assert "a" not in cache.entries
    cache.clear()
    assert cache.get(0) is None


def test_accounts(spark):
    own = spark.createDataFrame([(1, "Ann", "Ann", "A"), (2, "bob", None, None)], "account_id long, username string, firstname string, lastname string")
    emails = spark.createDataFrame([(1, "A@x.org", True), (1, "b@x.org", False), (2, "c@x.org", True)], "account_id long, email string, is_primary boolean")
    asked = spark.createDataFrame([("ANN",), ("ann",), ("nobody",), (None,)], "username string")
    assert sorted(map(tuple, accounts.email_addresses(own, emails, asked).collect())) == [("Ann", "A@x.org", True), ("Ann", "b@x.org", False)]
    assert [tuple(r) for r in accounts.public_info(own, "BOB").collect()] == [("bob", None, None)]
    more = accounts.put_email(emails, own, "BOB", "d@x.org")
    assert more.count() == 4 and accounts.put_email(emails, own, "nobody", "d").count() == 3
    assert sorted(r["email"] for r in accounts.delete_email(more, own, "ann", "a@X.ORG").collect()) == ["b@x.org", "c@x.org", "d@x.org"]


def units(spark, *texts):
    return spark.createDataFrame([(f"d{i}", 1, t, None) for i, t in enumerate(texts)], "text_id string, doc_type short, text string, parent string")


def vectors(spark):
    return spark.createDataFrame([(d, t, 0.5) for d, ts in {1: "ab", 2: "ab", 3: "bc", 4: "xy", 5: "xa"}.items() for t in ts], "doc_id long, term string, val double")


def paragraph(spark):
    return spark.createDataFrame([(d, [float(d), 1.0]) for d in range(1, 6)], "doc_id long, v array<float>")


def test_service_over_http(spark):
    history = spark.createDataFrame([(7, 1, 1), (7, 2, 2)], "user_id long, doc_id long, rank int")
    service = SearchService(spark, units(spark, "alpha beta", "beta gamma", "delta"), vectors(spark), paragraph(spark), history, lambda: units(spark, "nothing", "alpha"))
    server = serve(service, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def get(path, method="GET"):
        try:
            with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", method=method)) as answer:
                return answer.status, json.load(answer)
        except urllib.error.HTTPError as error:
            return error.code, json.load(error)

    try:
        status, found = get("/search?q=Alpha&maxResults=2")
        assert status == 200 and [r["_id"] for r in found["results"]] == ["d0"]
        assert get("/search?q=beta&maxResults=1&offset=1")[1]["results"][0]["_id"] == "d1"
        assert get("/search?q=unknown")[1]["numResults"] == 0
        assert get("/search")[0] == 422 and get("/search?q=a&maxResults=x")[0] == 422 and get("/other")[0] == 404
        assert [r["_id"] for r in get("/related-docs?docid=1&maxResults=2")[1]["results"]] == ["1", "2"]
        assert get("/related-docs?docid=99")[1]["numResults"] == 0
        assert {r["_id"] for r in get("/user-recommendations?userid=7")[1]["results"]} <= {"3", "4", "5"}
        assert get("/user-recommendations?userid=8")[1]["numResults"] == 0 and get("/user-recommendations")[0] == 422
        assert get("/notifynewdoc", "POST")[0] == 200 and get("/else", "POST")[0] == 404
        assert get("/search?q=Alpha&maxResults=2")[1]["results"][0]["_id"] == "d1"
    finally:
        server.shutdown()
        server.server_close()


def test_paged_harvest(spark, tmp_path):
    from lexforge.sources.harvest import PagedHarvest, page_path

    page = "<r xmlns='x'><record><metadata><arXiv><id>{}</id><title>t</title><authors><author><keyname>K</keyname></author></authors></arXiv></metadata></record><resumptionToken>{}</resumptionToken></r>"
    pages = {"": ("1", "a|1"), "a|1": ("2", "a|2"), "a|2": ("3", "")}

    def put(token):
        with open(page_path(str(tmp_path / "pages"), token), "w") as file:
            file.write(page.format(*pages[token]))

    def run():
        stream = spark.readStream.format("paged_harvest").load(str(tmp_path / "pages"))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
        try:
            for _ in range(5):
                query.processAllAvailable()
        finally:
            query.stop()
        return sorted(r["arXiv_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (tmp_path / "pages").mkdir()
    spark.dataSource.register(PagedHarvest)
    put(""), put("a|1")
    assert run() == ["1", "2"]
    put("a|2")
    assert run() == ["1", "2", "3"]  # goes on from the last token


def test_stream_builds_the_same_index(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i % 7} common text {i}") for i in range(40)], "doc_id long, text string")
    docs.repartition(5).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        index_stream.index_stream(index_stream.stream_folder(spark, str(tmp_path / "in"), "doc_id long, text string"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    docs.where("doc_id < 3").write.mode("append").parquet(str(tmp_path / "in"))  # seen before
    index_stream.index_stream(index_stream.stream_folder(spark, str(tmp_path / "in"), "doc_id long, text string"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    made = spark.read.parquet(str(tmp_path / "out/postings"))
    whole = log_weights(term_counts(docs, "doc_id"), "doc_id")
    key = ["doc_id", "term", "n", "lnc"]
    assert sorted(map(tuple, made.select(*key).collect())) == sorted(map(tuple, whole.select(*key).collect()))
    assert index_stream.unindexed(docs, made).count() == 0
    index_stream.add_batch(str(tmp_path / "out"))(docs.where("doc_id < 3"), 0)  # a batch that runs again
    assert spark.read.parquet(str(tmp_path / "out/postings")).groupBy("doc_id", "term").count().where("count > 1").count() == 0
