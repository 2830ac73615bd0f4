"""Near copies among very many texts of one template."""

import random

import pytest

from stackleaf.llm import shingle_links, simhash


@pytest.mark.parametrize("longest", [64, 2])
def test_copies_of_a_template(spark, longest, monkeypatch):
    """Planted copies (0.80 to 0.85 alike) among 1,500 texts that are about 0.7 alike all join, and nothing else does."""
    monkeypatch.setattr(shingle_links, "LIST", longest, raising=False)
    monkeypatch.setattr(shingle_links, "BLOCK", 200, raising=False)
    r = random.Random(4)
    word = lambda: f"w{r.randrange(10**6)}"
    template = [word() for _ in range(250)]
    made = [template + [word() for _ in range(r.choice([49, 53, 57]))] for _ in range(1300)]
    for k in range(200):
        own = list(made[k])
        own[255 : 255 + 24] = [word() for _ in range(24)]
        made.append(own)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in made]
    fp = [simhash.fingerprint(" ".join(w).encode(), 5) for w in made]
    label = list(range(len(made)))
    root = lambda i: i if label[i] == i else root(label[i])
    joined = 0
    for i in range(len(made)):
        for j in range(i):
            alike = 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
            if alike or (fp[i] ^ fp[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                label[b] = a
                joined += alike
    assert joined >= 200
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(made)], "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates_by_similarity(rows).collect()}
    assert got == {i: root(i) for i in range(len(made))}
