"""Registered queries against their SQL, and the shape of those without."""

import zlib

import pytest

from checks import compare
from matchline.llm import queries


@pytest.fixture(scope="module")
def con(folder):
    return compare.oracle_connection(folder)


@pytest.mark.parametrize("name", list(queries.SQL))
def test_same_rows(spark, folder, con, name):
    df = queries.QUERIES[name](spark, folder)
    assert df.count() > 0
    assert compare.type_difference(df, con, queries.SQL[name]) == []
    assert compare.difference(df, con, queries.SQL[name]) is None


def documents(spark, folder):
    return {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_language_accuracy(spark, folder):
    docs = documents(spark, folder)
    rows = queries.op4_language_id(spark, folder).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == is_held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    right = [docs[r.doc_id].lang == r.lang_pred for r in rows if r.held_out]
    assert sum(right) / len(right) > 0.95


def test_quality_accuracy(spark, folder):
    docs = documents(spark, folder)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.op3_quality(spark, folder).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == is_held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    right = [quality[r.doc_id] == r.predicted for r in rows if r.held_out and r.doc_id in quality]
    assert sum(right) / len(right) > 0.85
