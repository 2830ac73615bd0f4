"""Each stage of the pipeline on small documents with nulls, empty and repeated texts and clashing columns, against brute force; and on empty ones."""

import random
from collections import Counter

import pytest
import xxhash

import corpus_pipeline
from stackleaf.llm import mixing, piece_lattice, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, mix int, number string, kept_sha256 string, fp string, x0 int, shard int"
STAGES = dict(corpus_pipeline.STAGES)


def made():
    r = random.Random(11)
    word = lambda: f"w{r.randrange(5000)}"
    base = [[word() for _ in range(120)] for _ in range(5)]
    texts = [None, "", " \n", " ".join(base[0]), " ".join(base[0]).upper(), "a line of some length\nother", "x\nA line of some length \n"]
    for b in base:
        for n in (1, 3, 30):
            w = list(b)
            for _ in range(n):
                w[r.randrange(len(w))] = word()
            texts.append(" ".join(w))
    return [(i, t, "en", None if i % 4 == 0 else f"s{i % 3}", len(t or ""), 7, 1, "n", "k", "f", 2, 3) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(made(), SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(22)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(), SCHEMA)


def whole(rows):
    return Counter(tuple(r) for r in rows)


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "mixing", "pieces"]


def test_quality(spark, sf, docs):
    kept = {r.doc_id for r in queries.op9_quality_classifier(spark, sf).collect() if r.predicted}
    out = STAGES["quality"](spark, docs, sf)
    assert out.columns == docs.columns and whole(out.collect()) == whole(r for r in docs.collect() if r.doc_id in kept)


def test_lines(spark, sf, docs):
    key = lambda x: x.strip(b" \t\n\x0b\x0c\r").lower()
    raw = {r[0]: (r[1] or "").encode() for r in made()}
    first = {}
    for i in sorted(raw, reverse=True):
        for x in raw[i].split(b"\n"):
            first.setdefault(key(x), []).append(i)
    out = STAGES["line_dedup"](spark, docs, sf)
    assert out.columns == docs.columns
    for r in out.collect():
        kept = b"\n".join(x for x in raw[r.doc_id].split(b"\n") if len(key(x).decode()) < 10 or min(first[key(x)]) == r.doc_id)
        assert (r.text.encode(), r.n_chars, r.kept_sha256, r.x0) == (kept, len(kept.decode()), "k", 2)


def test_near_duplicates(spark, sf, docs):
    rows = made()
    words = [(r[1] or "").lower().split() for r in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]

    def print_of(w):
        h = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in ([w[i : i + 5] for i in range(len(w) - 4)] or ([w] if w else []))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = [print_of(w) for w in words]
    label = list(range(len(rows)))
    alike = lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 3 or (sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))
    for _ in rows:
        label = [min(label[j] for j in range(len(rows)) if i == j or alike(i, j)) for i in range(len(rows))]
    out = STAGES["near_duplicates"](spark, docs, sf)
    assert out.columns == docs.columns and whole(out.collect()) == whole(r for r in rows if label[r[0]] == r[0])


def test_mixing(spark, sf, docs):
    copies = {r.doc_id: r["mix_"].copies for r in mixing.mix(docs).collect()}
    out = STAGES["mixing"](spark, docs, sf)
    assert out.columns == docs.columns and whole(out.collect()) == Counter({r: copies[r[0]] for r in made() if copies[r[0]]})


def test_pieces(spark, sf, docs):
    lattice = piece_lattice.Lattice(piece_lattice.vocabulary())
    raw = {r[0]: (r[1] or "").encode() for r in made()}
    rows = STAGES["pieces"](spark, docs, sf).collect()
    assert len(rows) == len(raw)
    for r in rows:
        assert b"".join(lattice.bytes[i] for i in r.ids) == raw[r.doc_id] and (r.n_bytes, r.n_pieces) == (len(raw[r.doc_id]), len(r.ids))


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_and_null_ids(spark, sf, docs, name):
    empty = STAGES[name](spark, docs.limit(0), sf)
    assert empty.count() == 0
    rows = spark.createDataFrame([(None, t, *x) for _, t, *x in made()[:6]] + [(1, *made()[3][1:])] * 3, SCHEMA)
    out = STAGES[name](spark, rows, sf).collect()
    assert len(out) <= 30
    if name == "near_duplicates":
        assert sum(r.doc_id is None for r in out) == 6  # rows without an id stay


def test_whole_run(spark, sf):
    """The stages in turn, by hand, and run()."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), SCHEMA)
    raw = Counter((r.doc_id, len((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.n_bytes) for r in corpus_pipeline.run(spark, sf).collect()) == raw
