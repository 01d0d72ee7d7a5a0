from pyspark.sql import functions as F

import corpus_pipeline
from pagemill.llm import queries
from tests.conftest import DATA

from .fixtures import documents
from .test_dedup import plain_components, plain_lines, plain_matches


def test_stages_over_the_test_data(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, DATA)
        if name != "mixture":
            assert docs.columns == before.columns
            assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
    assert docs.filter("taken > 3 * size").count() == 0
    whole = corpus_pipeline.run(spark, DATA)
    key = lambda df: sorted(map(str, df.drop("positions").collect()))
    assert key(whole) == key(docs)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    kept = corpus_pipeline.quality(spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA).join(labels, "doc_id")
    assert kept.filter("quality = 0").count() <= 1
    assert kept.filter("quality = 1").count() >= 0.98 * labels.filter("quality = 1").count()


def test_stages_take_awkward_and_empty_tables(spark):
    docs = documents(spark)[0].select(*corpus_pipeline.COLUMNS)
    for start in (docs, docs.limit(0)):
        out = start
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, DATA)
        assert out.count() <= start.count()


def test_every_query_gives_a_row_a_record(spark):
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    for name in ("op2_quality_mil", "op5_language_backoff"):
        out = queries.QUERIES[name](spark, DATA)
        assert out.count() == n and out.filter(F.col("held_out")).count() > 0


def test_stages_match_plain_versions(spark):
    read = lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")
    rows = lambda df: sorted(tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect())
    docs = corpus_pipeline.quality(spark, read("documents"), DATA)
    before = rows(docs)
    gone = plain_lines(before)
    expected = []
    for i, text, lang, source, n in before:
        kept = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone[i, text])
        if kept.strip() or not gone[i, text]:
            expected.append((i, kept, lang, source, len(kept) if gone[i, text] else n))
    docs = corpus_pipeline.lines(spark, docs, DATA)
    assert rows(docs) == expected
    found = {i for i, _, c in plain_components(expected, 5, 8, 10) if i == c}
    docs = corpus_pipeline.near_copies(spark, docs, DATA)
    expected = [r for r in expected if r[0] in found]
    assert rows(docs) == expected
    hit = {r[0] for r in plain_matches(expected, [tuple(r) for r in read("benchmark").select("item_id", "text").collect()])}
    docs = corpus_pipeline.benchmark(spark, docs, DATA)
    expected = [r for r in expected if r[0] not in hit]
    assert rows(docs) == expected and hit
    assert sorted(r.doc_id for r in corpus_pipeline.mixture(spark, docs, DATA).collect()) == [r[0] for r in expected]
