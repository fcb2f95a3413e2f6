"""Small tables with the columns of the real ones and some more whose names operators use inside."""

from __future__ import annotations

import datetime as dt

PAPERS = """paper_id string, title string, abstract string, authors array<struct<firstname:string,lastname:string>>, body string, created string, journal string,
    refs array<struct<paper_id:string,cited_as:string,year:int>>, url string, other struct<para_vec:array<float>,tfidf_indexed:boolean,note:string>, harvested_at timestamp_ntz,
    id long, a string, b string, v string, v0 string, n long, word string, content string, anchor string, kind string, first string, h long, text string, vector string"""
DOCUMENTS = """doc_id long, text string, lang string, source string, n_chars long, parent_key string, doc_type short, added_at timestamp_ntz,
    ids string, n_tokens string, h string, bucket string, `left` string, chain string, garbled string"""
EXTRA_PAPER, EXTRA_DOCUMENT = 14, 7


def papers(spark, rows):
    """Rows are dicts; columns that they lack are null."""
    names = PAPERS_NAMES
    made = [tuple((r | {"harvested_at": r.get("harvested_at", dt.datetime(2020, 1, 1))}).get(n) for n in names) for r in rows]
    return spark.createDataFrame(made, PAPERS).coalesce(2)


def documents(spark, rows):
    return spark.createDataFrame([tuple(r.get(n) for n in DOCUMENT_NAMES) for r in rows], DOCUMENTS).coalesce(2)


def _names(schema):
    depth, out, word = 0, [], ""
    for c in schema:
        depth += c == "<"
        depth -= c == ">"
        if c == "," and depth == 0:
            out.append(word.split()[0].strip("`"))
            word = ""
        else:
            word += c
    return [*out, word.split()[0].strip("`")]


PAPERS_NAMES, DOCUMENT_NAMES = _names(PAPERS), _names(DOCUMENTS)
