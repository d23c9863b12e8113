"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chirplake.llm import htmltext, itq, licenses, linededup, merkle, mixing, mtree, quality, simhash, suffixpieces, tokenrecords, toxicity, whitening
from chirplake.llm.shared import saved


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = saved(table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words().alias("words")), "mix-words")
    planned = mixing.plan_mix(docs, F.col("words"))
    taken = F.col("mix.size") * F.col("mix.copies")
    return planned.select("row.doc_id", "mix.size", "mix.source_size", "mix.target", taken.alias("taken"))


def op2_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_products(table(spark, sf_dir, "embeddings")).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return htmltext.extract(pages).select("row.page_id", "row.url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("row.doc_id", simhash.hex16().alias("fingerprint"), "component_id")


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenrecords.encode_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenrecords.default_tokenizer())


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixpieces.encode(docs, suffixpieces.default_model()).select("row.doc_id", "ids", "n_ids", "ids_crc32", "same")


def op7_itq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = itq.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return near.select("row.vec_id", "n_links", "component_id", F.expr("row.vec_id <=> component_id").alias("kept"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_join(F.array_sort(F.array_distinct("found.license")), ",")
    return found.select("row.doc_id", F.size("found").alias("n_found"), names.alias("licenses"), F.array_max("found.coverage").alias("coverage"), "found")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.toxicity(docs, lexicon).select("row.doc_id", "score")
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select("row.doc_id", "text", "removed")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    even = (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0) & (F.instr("text", "\n") > 0)
    tampered = F.when(even, merkle.leaf(*own[:-1], F.replace("text", F.lit("\n"), F.lit(""))))
    proved = merkle.manifest(docs, merkle.leaf(*own), {"doc_id": F.col("doc_id"), "tampered": tampered})
    checked = merkle.verify(proved, F.coalesce("row.tampered", "leaf"))
    return checked.select("row.doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    whitened = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return whitened.select("row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op13_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.quality(docs, quality.learn(docs, table(spark, sf_dir, "labels"))).select("row.doc_id", "score")
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (
    op1_source_mix, op2_mtree_topk, op3_html_text, op4_simhash_dedup, op5_token_records, op6_sentencepiece, op7_itq_dedup,
    op8_license_scan, op9_toxicity, op10_line_dedup, op11_merkle_manifest, op12_embedding_whitening, op13_quality_score,
)}

ORACLE_SQL = {
    "op2_mtree_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM (SELECT DISTINCT * FROM v) q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
        r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 5""",
    "op1_source_mix": r"""
        WITH d AS (
            SELECT doc_id, source, md5(doc_id::VARCHAR) AS k,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
            FROM documents),
        s AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
            FROM d GROUP BY source),
        r AS (
            SELECT *, 2 * source_size AS cap,
                   coalesce(sum(2 * source_size) OVER (ORDER BY (2 * source_size) / weight, source NULLS LAST
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before,
                   sum(weight) OVER (ORDER BY (2 * source_size) / weight, source NULLS LAST
                       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS rest,
                   (sum(source_size) OVER ())::DOUBLE AS total
            FROM s),
        l AS (SELECT max(CASE WHEN (1.5 * total - before) / rest * weight <= cap THEN (1.5 * total - before) / rest END) AS level FROM r),
        t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(level * weight, cap::DOUBLE)) AS target FROM r, l),
        x AS (
            SELECT d.doc_id, d.source, d.k, d.size, t.source_size, t.target,
                   coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        c AS (
            SELECT source, c.copy, doc_id, k, size, (start + size + c.copy * source_size) / target AS time
            FROM x, (VALUES (0), (1)) c(copy) WHERE size > 0),
        q AS (SELECT *, sum(size) OVER (ORDER BY time, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS served FROM c),
        n AS (SELECT doc_id, k, source, count(*) AS copies FROM q WHERE served <= 1.5 * (SELECT sum(size) FROM d) GROUP BY ALL)
        SELECT x.doc_id, size, source_size, target, (size * coalesce(copies, 0))::BIGINT AS taken
        FROM x LEFT JOIN n ON x.doc_id = n.doc_id AND x.source IS NOT DISTINCT FROM n.source""",
    "op10_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
            FROM documents),
        n AS (
            SELECT doc_id, i, trim(line, E' \t\r\x0b\x0c') AS t, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k
            FROM l WHERE trim(line, E' \t\r\x0b\x0c') <> ''),
        w AS (
            SELECT doc_id, k, i AS i0, lead(i) OVER o AS i1, lead(i, 2) OVER o AS i2,
                   t || chr(10) || lead(t) OVER o || chr(10) || lead(t, 2) OVER o AS three
            FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        f AS (
            SELECT *, first_value(doc_id) OVER p AS doc0, first_value(k) OVER p AS k0
            FROM w WHERE i2 IS NOT NULL WINDOW p AS (PARTITION BY three ORDER BY doc_id, k)),
        g AS (
            SELECT DISTINCT doc_id, unnest([i0, i1, i2]) AS i, unnest([k, k + 1, k + 2]) AS pos, doc0, k0 FROM f
            WHERE (doc_id, k) <> (doc0, k0)),
        gone AS (SELECT DISTINCT doc_id, i FROM g WHERE doc_id <> doc0 OR pos >= k0 + 3),
        left_over AS (
            SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) FILTER (gone.i IS NULL) AS text, count(gone.i)::BIGINT AS removed
            FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id)
        SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(o.text, '') END AS text, coalesce(removed, 0) AS removed
        FROM documents d LEFT JOIN left_over o ON d.doc_id = o.doc_id""",
    "op11_merkle_manifest": """
        WITH RECURSIVE c AS (
            SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda x, k: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))) AS t),
        d AS (
            SELECT doc_id, source,
                   list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text], lambda f: coalesce(strlen(f) || ':' || f, '-')) AS own,
                   CASE WHEN xor(4294967295, list_reduce(
                       list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ord(s)::BIGINT)),
                       lambda x, b: xor(x >> 8, t[(xor(x, b) & 255) + 1]))) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other
            FROM documents, c),
        leaf AS (
            SELECT doc_id, source, sha256(array_to_string(own, '')) AS leaf,
                   sha256(array_to_string(own[:4], '') || coalesce(strlen(other) || ':' || other, '-')) AS tampered,
                   row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n
            FROM d),
        low AS (
            SELECT 0 AS level, source, idx, n, leaf AS hash FROM leaf
            UNION ALL
            SELECT level + 1, source, idx // 3, (n + 2) // 3, sha256(string_agg(hash, '' ORDER BY idx)) FROM low WHERE n > 1
            GROUP BY level, source, idx // 3, n),
        sub AS (SELECT source, hash AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
        high AS (
            SELECT 0 AS level, idx, n, subroot AS hash FROM sub
            UNION ALL
            SELECT level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(hash, '' ORDER BY idx)) FROM high WHERE n > 1
            GROUP BY level, idx // 3, n),
        steps AS (
            SELECT level, source, idx, n, coalesce(string_agg(hash, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                   coalesce(string_agg(hash, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
            FROM low WHERE n > 1 WINDOW r AS (PARTITION BY level, source, idx // 3 ORDER BY idx)),
        top_steps AS (
            SELECT level, idx, n, coalesce(string_agg(hash, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                   coalesce(string_agg(hash, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
            FROM high WHERE n > 1 WINDOW r AS (PARTITION BY level, idx // 3 ORDER BY idx)),
        climb AS (
            SELECT doc_id, source, 0 AS level, idx, n, tampered AS folded, '' AS proof FROM leaf
            UNION ALL
            SELECT c.doc_id, c.source, c.level + 1, c.idx // 3, (c.n + 2) // 3, sha256(s.l || c.folded || s.r), c.proof || s.l || s.r
            FROM climb c JOIN steps s ON c.level = s.level AND c.idx = s.idx AND c.source IS NOT DISTINCT FROM s.source),
        climb_on AS (
            SELECT c.doc_id, 0 AS level, sub.idx, sub.n, c.folded, c.proof, sub.subroot FROM climb c JOIN sub ON c.n = 1 AND c.source IS NOT DISTINCT FROM sub.source
            UNION ALL
            SELECT c.doc_id, c.level + 1, c.idx // 3, (c.n + 2) // 3, sha256(s.l || c.folded || s.r), c.proof || s.l || s.r, c.subroot
            FROM climb_on c JOIN top_steps s ON c.level = s.level AND c.idx = s.idx),
        root AS (SELECT hash AS root FROM high WHERE n = 1)
        SELECT c.doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
        FROM climb_on c JOIN leaf USING (doc_id), root WHERE c.n = 1""",
}
