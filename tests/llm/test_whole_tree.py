"""The language model is the whole context tree, however few n-grams travel with the tasks."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from stackleaf.llm import ctw


def test_scores_use_every_node(spark, monkeypatch):
    monkeypatch.setattr(ctw, "TOGETHER", 50, raising=False)
    r = random.Random(2)
    words = ["".join(r.choice("abcdeé ") for _ in range(r.randrange(2, 9))) for _ in range(60)]
    made = [None, "", *(" ".join(r.choices(words, k=r.randrange(1, 30))) for _ in range(60))]
    rows = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = {x.doc_id: x for x in ctw.score(rows, cells=64).collect()}
    train = [i for i in got if not got[i].held_out]
    tree, _ = ctw.learn(rows.where(F.col("doc_id").isin(train)).select("text"))
    for i, t in enumerate(made):
        codes, _ = ctw.grams([(t or "").lower().encode()], ctw.DEPTH)
        assert math.isclose(got[i].score, tree.slow(np.asarray(codes)).sum(), rel_tol=1e-9), i
