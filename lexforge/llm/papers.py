"""What the operators on papers share: one row per paper, and the words of a text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame

from ..operators.corpus import one_row_per_paper

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Maximal runs of letters and digits, lower-cased, in order."""
    runs = _WORD.findall(text)
    return "\n".join(runs).lower().split("\n") if runs else []


def one_per_paper(papers: DataFrame, *values: Column) -> DataFrame:
    """(paper_id, *values), named v0, v1 ..., with one row per ``paper_id``, that of its first harvest.

    Rows stay where they were read; only the keys of papers that come again are moved. Rows without a
    ``paper_id`` are no papers and drop out. Among copies of one time the choice falls by a hash of
    the values, so it doesn't depend on the order of the rows; a null time counts as the latest.
    """
    names = [f"v{i}" for i in range(len(values))]
    return one_row_per_paper(papers.select("paper_id", "harvested_at", *[v.alias(n) for v, n in zip(values, names)]), *names)
