"""Search, related documents and recommendations as a small HTTP service."""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.cache import ResultCache
from .operators.lexical import UnitIndex, search_units
from .operators.recommend import recommend_to, related
from .sources.sinks import envelope

NOTHING = json.dumps({"errno": 0, "errstr": "", "numResults": 0, "results": []})


class SearchService:
    """Answers requests from tables; results are kept two hours and dropped when a table changes.

    ``units`` (text_id, doc_type, text, parent) serve search. ``vectors`` (doc_id, term, val) and
    ``paragraph`` (doc_id, v) serve related documents and, with ``history`` (user_id, doc_id, rank),
    recommendations. ``reload`` is called when a new document is announced and returns new units.
    """

    def __init__(self, spark: SparkSession, units: DataFrame, vectors: DataFrame | None = None, paragraph: DataFrame | None = None, history: DataFrame | None = None, reload: Callable[[], DataFrame] | None = None, lifetime: float = 7200):
        self.spark, self.units, self.vectors, self.paragraph, self.history, self.reload = spark, units, vectors, paragraph, history, reload
        self.index = UnitIndex(units)
        self.cache = ResultCache(lifetime)
        #: Path to the parameter it needs and the method that answers it.
        self.routes = {"/search": ("q", self.search), "/related-docs": ("docid", self.related), "/user-recommendations": ("userid", self.recommended)}

    def changed(self, units: DataFrame) -> None:
        """Index other units; kept results are dropped. Requests only ask the index."""
        self.units, self.index = units, UnitIndex(units)
        self.cache.clear()

    def search(self, text: str, most: int, offset: int) -> str:
        """The JSON envelope of a query's results offset + 1 to offset + most."""
        query = self.spark.createDataFrame([(0, " ".join(text.lower().split()))], "query_id int, text string")
        return self._page(search_units(query, self.index, n=offset + most).where(F.col("rank") > offset))

    def related(self, doc: str, most: int, offset: int) -> str:
        if self.vectors is None or self.paragraph is None:
            return NOTHING
        seed = self.spark.createDataFrame([(doc,)], "doc_id string").select(F.col("doc_id").cast(self.vectors.schema["doc_id"].dataType))
        return self._page(related(seed, self.vectors, self.paragraph, "doc_id", most, offset))

    def recommended(self, user: str, most: int, offset: int) -> str:
        if self.history is None or self.vectors is None or self.paragraph is None:
            return NOTHING
        known = self.history.where(F.col("user_id").cast("string") == user).select("user_id").first()
        if known is None:
            return NOTHING
        found = recommend_to(known["user_id"], self.history, self.vectors, self.paragraph, n=most, offset=offset).collect()  # a page
        return json.dumps({"errno": 0, "errstr": "", "numResults": len(found), "results": [{"_id": str(r["doc_id"]), "score": r["score"]} for r in found]})

    def _page(self, found: DataFrame) -> str:
        row = envelope(found).first()
        return row["json"] if row else NOTHING

    def answer(self, target: str) -> tuple[int, str]:
        """Status and body for a request's path and parameters; a number of results of 0 means 10."""
        url = urlparse(target)
        given = {k: v[0] for k, v in parse_qs(url.query).items()}
        path = url.path.rstrip("/")
        if path not in self.routes:
            return 404, json.dumps({"errno": 1, "errstr": "no such resource"})
        name, method = self.routes[path]
        if name not in given:
            return 422, json.dumps({"errno": 2, "errstr": f"parameter {name} is missing"})
        try:
            most, offset = int(given.get("maxResults", 0)) or 10, int(given.get("offset", 0))
        except ValueError:
            return 422, json.dumps({"errno": 2, "errstr": "maxResults and offset are numbers"})
        kept = self.cache.get((path, given[name]), most=most, offset=offset)
        if kept is None:
            kept = method(given[name], most, offset)
            self.cache.put((path, given[name]), kept, most=most, offset=offset)
        return 200, kept

    def notify(self, target: str) -> tuple[int, str]:
        """A new document was announced: the tables are read again and kept results dropped."""
        if urlparse(target).path.rstrip("/") != "/notifynewdoc":
            return 404, json.dumps({"errno": 1, "errstr": "no such resource"})
        self.changed(self.reload() if self.reload else self.units)
        return 200, json.dumps({"errno": 0, "errstr": ""})


def serve(service: SearchService, port: int = 8086) -> HTTPServer:
    """A server for ``service``; the caller runs and closes it."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: str) -> None:
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.end_headers()
            self.wfile.write(body.encode())

        def do_GET(self) -> None:
            self._send(*service.answer(self.path))

        def do_POST(self) -> None:
            self._send(*service.notify(self.path))

        def log_message(self, *_) -> None:
            pass

    return HTTPServer(("127.0.0.1", port), Handler)
