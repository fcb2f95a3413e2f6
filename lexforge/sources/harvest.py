"""A paged harvest as a streaming source: its offset is the token that names the next page.

    spark.dataSource.register(PagedHarvest)
    spark.readStream.format("paged_harvest").load("/folder/of/pages")

Pages are files named by their token (``first.xml`` for none), as a fetcher leaves them. A restart
goes on from the token of the last finished batch.
"""

from __future__ import annotations

import os
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

SCHEMA = "arXiv_id string, title string, abstract string, created string, authors array<struct<firstname:string,lastname:string>>"


def _local(element: ET.Element) -> str:
    return element.tag.rpartition("}")[2]


def _child(element: ET.Element, name: str) -> str | None:
    return next((x.text for x in element if _local(x) == name), None)


def parse_page(content: bytes) -> tuple[list[tuple], str | None]:
    """The records of a page and the token of the next, None after the last."""
    rows, token = [], None
    for element in ET.fromstring(content).iter():
        if _local(element) == "arXiv":
            authors = [(_child(a, "forenames"), _child(a, "keyname")) for a in element.iter() if _local(a) == "author"]
            rows.append((_child(element, "id"), _child(element, "title"), _child(element, "abstract"), _child(element, "created"), authors))
        elif _local(element) == "resumptionToken":
            token = (element.text or "").strip() or None
    return rows, token


def page_path(folder: str, token: str) -> str:
    return os.path.join(folder, (quote(token, safe="") if token else "first") + ".xml")


class _Pages(SimpleDataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"token": "", "done": False}

    def _page(self, token: str) -> tuple[list[tuple], dict]:
        path = page_path(self.folder, token)
        if not os.path.exists(path):  # not fetched yet
            return [], {"token": token, "done": False}
        with open(path, "rb") as file:
            rows, following = parse_page(file.read())
        return rows, {"token": token if following is None else following, "done": following is None}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if start["done"]:
            return iter([]), start
        rows, end = self._page(start["token"])
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([] if start["done"] or start == end else self._page(start["token"])[0])


class PagedHarvest(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_harvest"

    def schema(self) -> StructType | str:
        return SCHEMA

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Pages(self.options["path"])
