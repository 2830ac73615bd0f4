"""The queries opN_<name>: each applies its operator, with production parameters, to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw, piece_lattice, quality, secrets
from .common import table
from .exact_dedup import exact_dedup
from .line_dedup import dedup_lines
from .mixing import mix
from .simhash import near_duplicates
from .suffix_dedup import remove_repeats
from .topk import top_k

Query = Callable[[SparkSession, str], DataFrame]


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["kind"] < 3)

    def number(kind: int) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    counts = [number(k).alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])]
    return spans.select("doc_id", *counts, F.sha2(secrets.described(base), 256).alias("base_sha256"), secrets.described(F.col("found")).alias("spans"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), keep_text=False)
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.copies") * F.col("mix.size")).alias("taken"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, most=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_lattice.digests(table(spark, sf_dir, "documents"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(quality.held_out(F.col("doc_id"), 5) != 0)
    stats = quality.measure(table(spark, sf_dir, "documents"))
    scored = quality.score(stats, quality.fit(stats, labels))
    return scored.select(F.col("id").alias("doc_id"), F.coalesce(quality.held_out(F.col("id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_secret_scans": op1_secret_scans,
        "op2_line_dedup": op2_line_dedup,
        "op3_source_mixing": op3_source_mixing,
        "op4_lm_scoring": op4_lm_scoring,
        "op5_simhash_near_dedup": op5_simhash_near_dedup,
        "op6_exact_topk": op6_exact_topk,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_suffix_array_dedup": op8_suffix_array_dedup,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_exact_dedup": op10_exact_dedup,
        "pipeline": pipeline,
    }


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op2_line_dedup": """
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents),
        keyed AS (
            SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM lines),
        firsts AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
        judged AS (SELECT keyed.*, first IS NOT NULL AND doc_id > first AS gone FROM keyed LEFT JOIN firsts USING (k))
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id""",
    "op3_source_mixing": r"""
        WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
        sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
        weighed AS (SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT] AS w, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM sources),
        filling AS (SELECT *, total - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
            sum(w) OVER (ORDER BY cap::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM weighed),
        judged AS (SELECT *, cap * ws <= rest * w AS is_full, cap::DOUBLE / w AS turn FROM filling),
        level AS (SELECT rest AS level_rest, ws AS level_ws FROM judged WHERE NOT is_full ORDER BY turn, source ASC NULLS LAST LIMIT 1),
        goals AS (SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE (level_rest * w)::DOUBLE / level_ws::DOUBLE END AS target FROM judged LEFT JOIN level ON true),
        each_one AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS each FROM goals),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size NULLS FIRST, doc_id NULLS FIRST) - 1 AS rank FROM sized),
        drawn AS (SELECT *, ('0x' || substr(md5('mix:' || coalesce('=' || source, 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM each_one)
        SELECT doc_id, size, source_size, target, size * least(floor(each * (rank + 1)::DOUBLE + u)::BIGINT - floor(each * rank::DOUBLE + u)::BIGINT, 3) AS taken
        FROM ranked JOIN drawn ON ranked.source IS NOT DISTINCT FROM drawn.source""",
    "op6_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op10_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {LOWER} AS x FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
            doc_id = max(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256
        FROM t""",
}


def repeats_sql(span: int, out: str) -> str:
    """The maximal runs (row, lo, hi) of bytes in strings of ``span`` bytes that also start elsewhere: every window by its digest."""
    return f"""{out}_w AS MATERIALIZED (SELECT row, s, md5(substr(h, 2 * s + 1, {2 * span})) AS m FROM (SELECT row, h, unnest(range(0, n - {span - 1})) AS s FROM d WHERE n >= {span})),
        {out}_r AS (SELECT row, s FROM {out}_w WHERE m IN (SELECT m FROM {out}_w GROUP BY m HAVING count(*) > 1)), {out}_b AS (SELECT row, s, coalesce(s > lag(s) OVER (PARTITION BY row ORDER BY s) + {span}, true)::INTEGER AS b FROM {out}_r),
        {out}_i AS (SELECT row, s, sum(b) OVER (PARTITION BY row ORDER BY s ROWS UNBOUNDED PRECEDING) AS i FROM {out}_b), {out} AS MATERIALIZED (SELECT row, min(s) AS lo, max(s) + {span} AS hi FROM {out}_i GROUP BY row, i)"""


REPEATS = f"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents), {repeats_sql(400, 'gone')}, {repeats_sql(256, 'passage')},
        cuts AS (SELECT row, lo, hi, coalesce(lag(hi) OVER (PARTITION BY row ORDER BY lo), 0) AS before FROM gone),
        left_ AS (SELECT row, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS pieces, max(hi) AS last FROM cuts JOIN d USING (row) GROUP BY row),
        held AS (SELECT row, sum(hi - lo)::BIGINT AS n_repeated FROM passage GROUP BY row)
        SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(pieces || substr(h, 2 * last + 1), h))) AS kept_sha256, coalesce(n_repeated, 0) AS n_repeated FROM d LEFT JOIN left_ USING (row) LEFT JOIN held USING (row)"""


def oracle_sql() -> dict[str, str]:
    return ORACLE | {"op1_secret_scans": secrets.oracle_sql(), "op8_suffix_array_dedup": REPEATS}
