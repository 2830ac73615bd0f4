"""Lists of many queries: equal to scoring every document, without cutting the documents again for each block of queries."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stackleaf.operators import lexical as X

RANDOM = random.Random(3)
WORDS = [f"w{i}" for i in range(60)]
TEXTS = [(i, " ".join(RANDOM.choices(WORDS, [1 / (j + 1) for j in range(60)], k=RANDOM.randint(0, 40)))) for i in range(300)]
TEXTS += [(1000 + i, t) for i, t in TEXTS[:90]] + [(2000, ""), (2001, None)]
QUERIES = [(i, " ".join(RANDOM.sample(WORDS, RANDOM.randint(1, 9)))) for i in range(0, 240, 2)] + [(1001, "unheard of"), (1003, "w0"), (1005, "")]


def every(k):
    docs = [(i, Counter((t or "").split())) for i, t in TEXTS]
    n, avgdl = len(docs), sum(sum(c.values()) for _, c in docs) / len(docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for q, text in QUERIES:
        found = []
        for i, c in docs:
            met, dl = [t for t in set(text.split()) if t in c], sum(c.values())
            idf = {t: (n - df[t] + 0.5) / (df[t] + 0.5) for t in met}
            if met:
                found.append((-round(sum((math.log(x) if (x := idf[t]) > 1 else 1e-6) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * dl / avgdl)) for t in met), 6), i))
        out += [(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("seeded", "block", "k"), [(10**9, 10**6, 5), (0, 10**6, 5), (0, 100, 3), (10**9, 10**6, 1), (0, 10**6, 1000)])
def test_best_of_all_documents(spark, monkeypatch, seeded, block, k):
    monkeypatch.setattr(X, "SEEDED", seeded, raising=False)
    monkeypatch.setattr(X, "BLOCK", block)
    docs = spark.createDataFrame(TEXTS, "doc_id long, body string").repartition(5)
    got = X.word_list(docs, spark.createDataFrame(QUERIES, "query_id long, text string"), k)
    assert sorted(tuple(r) for r in got.select("query_id", "doc_id", "score", "rank").collect()) == every(k)


def test_documents_are_cut_once_for_all_queries(spark):
    cut = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            cut.add(b.num_rows)
            yield b

    docs = spark.createDataFrame(TEXTS, "doc_id long, body string").mapInArrow(seen, "doc_id long, body string")
    queries = spark.range(3000).select(F.col("id").alias("query_id"), F.concat(F.lit("w"), (F.col("id") % 60).cast("string")).alias("text"))
    assert X.word_list(docs, queries, 2).select("query_id").distinct().count() == 3000
    assert cut.value == len(TEXTS)


@pytest.mark.parametrize("kind", [X.word_list, X.part_list])
def test_python_gets_batches_of_few_documents(spark, kind):
    large = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            large.add(b.num_rows > 1024)
            yield b

    docs = spark.range(5000, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat(F.lit("word w"), F.col("id").cast("string")).alias("body")).mapInArrow(seen, "doc_id long, body string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = kind(docs, spark.createDataFrame([(1, "w4999")], "query_id long, text string"), 5).collect()
    assert [(r.query_id, r.doc_id) for r in got] == [(1, 4999)] and large.value == 0
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_page_signals_where_partitions_stay_as_dealt(spark):
    from stackleaf.plans import search

    own = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "13"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        assert search.q_signals(spark, "/root/testdata/sf0.001").count() == 40
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
