"""The queries opN_<name> of this folder: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import ball_kmeans, ball_tree, curriculum, decontaminate, filter_audit, language, line_dedup, main_text, ngram_join, pii, quality_mil, repeats, warc


def op1_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, read back in chunks: digests, lengths and what repeated payloads refer to."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.records(warc.read_chunks(warc.write_archives(pages), data=False)).drop("verified")


def _fold(modulus: int, held: int):
    """Whether a row is held out by crc32 of its doc_id as text; never for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == held, F.lit(False))


def op2_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all texts by a model of the labels outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = quality_mil.learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~_fold(3, 1))
    return quality_mil.scored(docs, model).select("doc_id", _fold(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and a digest of the base spans, and all spans, of every whole text; n_spans counts base and added ones."""
    found = pii.find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("base", lambda c: c["kind"] == pii.KINDS.index(k))).cast("long").alias(f"n_{k}")
    every = F.concat("base", "added")
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(pii.digest(F.col("base")), 256).alias("base_sha256"), pii.digest(every).alias("spans"), F.size(every).cast("long").alias("n_spans"))


def op4_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every text without the 100-byte strings that also start earlier."""
    kept = repeats.without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_language_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted languages of all texts by a model of those outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.learned(docs.select("doc_id", "text", "lang"), ~_fold(4, 2))
    return language.identified(docs.select("doc_id", "text"), model).select("doc_id", _fold(4, 2).alias("held_out"), "lang_pred", "score")


def op6_ball_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest inner products of every hundredth vector with all others."""
    return ball_tree.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that 3-word shingles link at 0.9."""
    return ngram_join.groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, num=9, den=10)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without lines that match an earlier one, as digests."""
    kept = line_dedup.deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op8_mixing_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, targets and words taken of all documents, in the order of their first position."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return curriculum.in_order(docs).select("doc_id", "size", "source_size", "target", "taken", "first_position")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 0.8 of an item's 5-word shingles."""
    found = decontaminate.matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "n_found", "n_item")


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors of 64 components after five rounds, with inertias and digests of centroids."""
    found = ball_kmeans.with_inertia(*ball_kmeans.clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))


def op12_host_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each language in all 120 orders."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return filter_audit.audit(read("documents"), read("labels"))


QUERIES = {f.__name__: f for f in (op1_warc_chunks, op2_quality_mil, op3_pii_boosting, op4_repeated_bytes, op5_language_backoff, op6_ball_tree_topk, op7_ngram_jaccard, op9_line_dedup, op8_mixing_curriculum, op10_decontamination, op11_ball_kmeans, op12_host_suffixes, op13_filter_audit)}


def _words(column: str) -> str:
    """SQL for the words of a column, A-Z lower-cased."""
    return rf"regexp_extract_all(translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def _kmeans_sql(k: int = 40, rounds: int = 5) -> str:
    """SQL of k-means: a pair of tables a round."""
    own = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - x[i]) * (v[i] - x[i])))"
    nearest = lambda r: f"SELECT vec_id, v, arg_min({{'c': c, 'd': d}}, d * {k} + c) AS a FROM (SELECT rid, vec_id, v, c, CAST({own} AS BIGINT) AS d FROM k CROSS JOIN c{r}) GROUP BY rid, vec_id, v"
    parts = [f"""
        WITH k AS MATERIALIZED (
            SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS x FROM (SELECT v, sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM k ORDER BY h LIMIT {k}))"""]  # fmt: skip
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED ({nearest(r)})")
        if r < rounds:
            parts.append(f"m{r} AS (SELECT c, list(m ORDER BY i) AS x FROM (SELECT a.c AS c, i, (sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM a{r}, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY c)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c, list_transform(coalesce(m{r}.x, c{r}.x), lambda y: CAST(y AS BIGINT)) AS x FROM c{r} LEFT JOIN m{r} USING (c))")
    return ",\n        ".join(parts) + f"""
        SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
          sha256(array_to_string(x, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} ON c{rounds}.c = a.c"""


ORACLES = {
    "op12_host_suffixes": r"""
        WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '[\x09-\x0D\x20]+', ' ', 'g') AS a FROM pages),
        b AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(regexp_replace(a, '<br>', ' ', 'g'), '</?(p|h1)>', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)) AS b FROM a),
        e AS (SELECT page_id, url, list_transform(b, lambda x: regexp_replace(regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g')) AS e FROM b),
        d AS (SELECT page_id, url, list_transform(e, lambda x: trim(regexp_replace(regexp_replace(replace(x, '&#x27;', chr(39)), '&amp;?', '&', 'g'), ' +', ' ', 'g'))) AS d FROM e),
        t AS (SELECT page_id, url, array_to_string(list_filter(d, lambda x: x <> ''), chr(10)) AS text, CAST(len(list_filter(d, lambda x: x <> '')) AS INTEGER) AS n_blocks FROM d)
        SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars, n_blocks, 0 AS n_repeated FROM t""",
    "op11_ball_kmeans": _kmeans_sql(),
    "op13_filter_audit": r"""
        WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS copy FROM t),
        l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
        m AS (
            SELECT part, CAST(len(w) < 100 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INTEGER) + 4 * CAST(100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) AS INTEGER)
                + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER) + 16 * CAST(copy AS INTEGER) AS mask, quality, toxic
            FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
        c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM m GROUP BY part, mask),
        x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
            WHERE a.x <> b.x AND c.x NOT IN (a.x, b.x) AND d.x NOT IN (a.x, b.x, c.x) AND e.x NOT IN (a.x, b.x, c.x, d.x)),
        s AS (
            SELECT filter_order, CAST(i AS INTEGER) AS step, 1 << (ascii(filter_order[i]) - 65) AS own, coalesce(list_sum(list_transform(range(1, i), lambda j: 1 << (ascii(filter_order[j]) - 65))), 0) AS before
            FROM o, range(1, 6) r(i)),
        r AS (
            SELECT part, filter_order, step, own, CAST(coalesce(sum(n) FILTER (mask & (own + before) = 0), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before = 0), 0) AS BIGINT) AS removed,
              CAST(coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before <> 0), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (mask = own), 0) AS BIGINT) AS unique_fails,
              CAST(coalesce(sum(good) FILTER (mask & own <> 0 AND mask & before = 0), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & before = 0), 0) AS BIGINT) AS toxic_lost
            FROM s CROSS JOIN c GROUP BY part, filter_order, step, own)
        SELECT * EXCLUDE (own), CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r""",
    "op1_warc_chunks": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS n, sha256(html) AS digest FROM p),
        f AS (SELECT digest, min(page_id) AS first_page FROM d WHERE n >= 100 GROUP BY digest)
        SELECT page_id, n AS payload_bytes, d.digest AS payload_digest,
               CASE WHEN first_page <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first_page <> page_id THEN first_page END AS refers_to
        FROM d LEFT JOIN f ON d.digest = f.digest""",
    "op6_ball_tree_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op4_repeated_bytes": r"""
        WITH h AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
        c AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS p FROM h WHERE length(h) >= 200),
        s AS (SELECT doc_id, p, md5_number(substr(h, CAST(2 * p + 1 AS BIGINT), 200)) AS s FROM c),
        r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM s) WHERE k > 1),
        m AS (SELECT doc_id, p, p - lag(p, 1, -1000) OVER (PARTITION BY doc_id ORDER BY p) > 100 AS new FROM r),
        i AS (SELECT doc_id, p, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM m),
        v AS (SELECT doc_id, k, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY doc_id, k),
        x AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS was FROM v),
        t AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans, max(b) AS last, list({'f': was, 't': a} ORDER BY a) AS gaps FROM x GROUP BY doc_id)
        SELECT h.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
          sha256(unhex(CASE WHEN gaps IS NULL THEN h ELSE array_to_string(list_transform(gaps, lambda g: substr(h, CAST(2 * g.f + 1 AS BIGINT), CAST(2 * (g.t - g.f) AS BIGINT))), '') || substr(h, CAST(2 * last + 1 AS BIGINT)) END)) AS kept_sha256
        FROM h LEFT JOIN t ON t.doc_id = h.doc_id""",
    "op7_ngram_jaccard": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, {_words("text")} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i:i + 2], ' '))) AS shingle FROM w WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT r.a AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a""",
    "op9_line_dedup": rf"""
        WITH l AS (SELECT doc_id, unnest(range(len(x))) AS no, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
        w AS (SELECT doc_id, no, {_words("line")} AS w FROM l),
        s AS (SELECT DISTINCT doc_id, no, hash(unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' ')))) AS shingle FROM w WHERE len(w) > 0),
        n AS (SELECT doc_id, no, count(*) AS n FROM s GROUP BY doc_id, no),
        p AS (SELECT a.doc_id, a.no, b.doc_id AS d, b.no AS m, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.no < a.no)) GROUP BY ALL),
        g AS (SELECT DISTINCT p.doc_id, p.no FROM p JOIN n x ON x.doc_id = p.doc_id AND x.no = p.no JOIN n y ON y.doc_id = p.d AND y.no = p.m WHERE 10 * c >= 8 * (x.n + y.n - c)),
        k AS (SELECT l.doc_id, l.no, line, g.no IS NOT NULL AS gone FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.no = g.no)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM k GROUP BY doc_id""",
    "op10_decontamination": r"""
        WITH t AS (
            SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
        w AS (
            SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM t),
        s AS (
            SELECT DISTINCT side, id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS shingle
            FROM w WHERE len(w) > 0),
        n AS (SELECT id, count(*) AS n FROM s WHERE side = 'i' GROUP BY id)
        SELECT d.id AS doc_id, i.id AS item_id, CAST(count(*) AS INTEGER) AS n_found, CAST(any_value(n.n) AS INTEGER) AS n_item
        FROM s d JOIN s i ON d.shingle = i.shingle AND d.side = 'd' AND i.side = 'i' JOIN n ON n.id = i.id
        GROUP BY d.id, i.id HAVING 10 * count(*) >= 8 * any_value(n.n)""",
}
