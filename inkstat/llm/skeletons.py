"""Problem 2: records that read the same although their stored characters differ.

Method: confusables skeleton. Every field is decomposed, each character replaced by its prototype, decomposed again;
records are grouped by the 128-bit hash of the skeletons of title and text.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstat.llm.chars import consistent, skeleton
from inkstat.llm.skew import salted_join
from inkstat.runtime import cut, spread

#: Documents or versions of one skeleton that a task gets at once.
SALT_ROWS = 1000
KEYS = T.StructType([T.StructField("skeleton", T.StringType()), T.StructField("stored", T.StringType())])
FORMS = T.StructType([T.StructField("title_form", T.StringType()), T.StructField("text_form", T.StringType())])


def _h(*parts: str) -> str:
    m = hashlib.md5(usedforsecurity=False)
    for p in parts:
        b = p.encode("utf-8", "surrogatepass")
        m.update(len(b).to_bytes(8, "little"))
        m.update(b)
    return m.hexdigest()


@F.pandas_udf(KEYS)
def _keys(title: pd.Series, text: pd.Series) -> pd.DataFrame:
    rows = [
        (_h(skeleton(a), skeleton(b)), _h(a or "", b or ""))
        for a, b in zip(title.where(title.notna(), None), text.where(text.notna(), None))
    ]
    return pd.DataFrame(rows, columns=["skeleton", "stored"])


@F.pandas_udf(FORMS)
def _forms(title: pd.Series, text: pd.Series) -> pd.DataFrame:
    rows = [(consistent(a), consistent(b)) for a, b in zip(title.where(title.notna(), None), text.where(text.notna(), None))]
    return pd.DataFrame(rows, columns=["title_form", "text_form"])


def skeleton_keys(docs: DataFrame) -> DataFrame:
    """``(doc_id, skeleton, stored)``, one row for each distinct stored version of a document with non-empty text, written
    once: some 70 bytes a row stand for the texts from here on.

    A null title reads as an empty one. Rows with null doc_id, or null or empty text, have no class and are left
    out. Repeated rows count once. Other columns are not read.
    """
    d = spread(docs.select("doc_id", "title", "text"), "doc_id")
    d = d.filter(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    return cut(d.select("doc_id", _keys("title", "text").alias("k")).select("doc_id", "k.skeleton", "k.stored").distinct())


def classes(docs: DataFrame) -> DataFrame:
    """``(doc_id, class_id, class_size, versions)``: each document with the smallest doc_id that reads the same."""
    k = skeleton_keys(docs)
    g = k.groupBy("skeleton").agg(
        F.min("doc_id").alias("class_id"),
        F.count_distinct("doc_id").alias("class_size"),
        F.count_distinct("stored").alias("versions"),
    )
    return k.select("doc_id", "skeleton").distinct().join(g, "skeleton").select("doc_id", "class_id", "class_size", "versions")


def same_reading_pairs(docs: DataFrame) -> DataFrame:
    """``(doc_id_a, doc_id_b)`` of documents with equal skeletons and different stored characters.

    Documents stored alike are first folded into one version, so a group of copies, however large, meets the other
    versions of its skeleton once; only the pairs asked for are written out. Skeletons with one version leave before
    the join, and what very many documents share is spread over several tasks.
    """
    k = skeleton_keys(docs)
    many = k.groupBy("skeleton").agg(F.min("stored").alias("lo"), F.max("stored").alias("hi")).filter("lo < hi").select("skeleton")
    k = k.join(many, "skeleton", "left_semi")
    v = k.select("skeleton", "stored").distinct()
    pairs = salted_join(v.withColumnRenamed("stored", "sa"), v.withColumnRenamed("stored", "sb"), ["skeleton"], "sb", SALT_ROWS).where("sa < sb")
    for s, d in (("sa", "da"), ("sb", "db")):
        pairs = salted_join(pairs, k.select("skeleton", F.col("stored").alias(s), F.col("doc_id").alias(d)), ["skeleton", s], d, SALT_ROWS)
    pairs = pairs.where("da <> db")
    return pairs.select(F.least("da", "db").alias("doc_id_a"), F.greatest("da", "db").alias("doc_id_b")).distinct()


def consistent_forms(docs: DataFrame) -> DataFrame:
    """``(doc_id, title_form, text_form)``: both fields in one consistent, readable form; nulls stay null."""
    d = spread(docs.select("doc_id", "title", "text"), "doc_id").dropDuplicates()
    return d.select("doc_id", _forms("title", "text").alias("f")).select("doc_id", "f.title_form", "f.text_form")
