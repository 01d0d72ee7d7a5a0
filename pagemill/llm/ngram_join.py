"""N-gram Jaccard join of documents with several global token orders.

A linking pair must share a prefix token under each order; the filters are
intersected before overlaps are computed exactly (see ``setjoin``).

Defined cases: a null or empty text, or one of white space, has an empty set
and links with nothing; a text of fewer than k words is one shingle; equal
texts are one class and always linked; rows that repeat a doc_id are documents
of their own that carry one id; a null doc_id is never the smallest, and a
component of such rows only has a null id. Extra columns are dropped by ``groups``
and kept by ``deduplicated``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.components import components
from pagemill.llm.setjoin import Spec, links, scan
from pagemill.llm.work import NO_ID, freed, removed, row_key, without, written


def _components(docs: DataFrame, spec: Spec) -> tuple[DataFrame, DataFrame]:
    """All units; and (node, component_id, first) of the nodes of components of several rows, ``first`` being the component's first row (no_id, doc, text_id)."""
    units, counts = scan(docs, spec)
    key = F.coalesce("doc_id", F.lit(NO_ID).cast("long"))
    places = [F.min(F.struct(key.alias("doc"), "text_id", "unit")).alias("home"), F.min("doc_id").alias("first_doc"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), key.alias("doc"), "text_id")).alias("first")]
    classes = units.filter("node is not null").groupBy("node").agg(*places, F.first("n").alias("n"), F.count("*").alias("copies"))
    classes = written(classes.select("node", "home.*", "n", "first_doc", "first", "copies"), "classes")
    found = components(links(docs, spec, classes.select("node", "doc", "text_id", "unit", "n"), counts, units=units.filter("node is not null")))
    joined = classes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = joined.groupBy("root").agg(F.min("first_doc").alias("component_id"), F.min("first").alias("first"), F.sum("copies").alias("rows")).filter("rows > 1")
    named = written(joined.select("node", "root").join(least, "root").select("node", "component_id", "first"), "components")
    removed(joined)
    return units, named


def groups(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10, orders: int = 2) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links)."""
    units, named = _components(docs, Spec(k, num, den, False, orders))
    out = units.join(named, "node", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10, orders: int = 2) -> DataFrame:
    """``docs`` with one row of each component, that with the smallest doc_id (null last), then by a fingerprint of the text; all columns are kept.

    Rows are told apart by doc_id and text; of rows alike in both one stays, where they have words.
    """
    units, named = _components(docs, Spec(k, num, den, False, orders, True))
    rows = units.select("node", F.coalesce("doc_id", F.lit(NO_ID).cast("long")).alias("doc"), "text_id").join(named.select("node", "first.doc", "first.text_id").toDF("node", "first_doc", "first_text"), "node")
    is_first = (F.col("doc") == F.col("first_doc")) & (F.col("text_id") == F.col("first_text"))
    gone = written(rows.groupBy("doc", "text_id").agg(F.bool_or(is_first).alias("stays"), F.count("*").alias("rows")).filter("not stays or rows > 1"), "near-copies")
    removed(rows)
    freed(docs.sparkSession)
    rest = without(docs, gone)
    again = gone.filter("stays").select(F.col("doc").alias("__doc"), F.col("text_id").alias("__text"))
    once = docs.withColumns(row_key()).join(again, ["__doc", "__text"], "left_semi").dropDuplicates(["__doc", "__text"]).select(*docs.columns)
    return rest.unionByName(once)
