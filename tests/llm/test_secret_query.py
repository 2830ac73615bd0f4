"""op1's query against Python's regular expressions, with the models' spans from the same ratios; long texts; held-out strings."""

import hashlib
import random
import re
import string
import time

import duckdb

from stackleaf.llm import queries, secrets

PATTERNS = (
    (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 8),
    (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
)


def expected(text, model):
    t = text or ""
    base = [(m.start(), k, m.end()) for k, (p, fine) in enumerate(PATTERNS) for m in p.finditer(t) if fine(m)]

    def ratio(token):
        codes = [0, *map(ord, token)]
        return sum(model[a * 128 + b] for a, b in zip(codes, codes[1:], strict=False))

    found = list(base)
    for chars in ("A-Za-z0-9+/_=-", "A-Za-z0-9"):
        held = list(found)
        runs = [(m.start(), 3, m.end()) for m in re.finditer(f"[{chars}]{{20,}}", t) if ratio(m[0]) >= 14_000]
        if chars == "A-Za-z0-9+/_=-":
            judged = runs  # runs that touch a base span go, and so do the pieces that touch such a run
        else:
            held += [r for r in judged if r not in held]
        found += [r for r in runs if not any(a < r[2] and r[0] < z for a, _, z in held)]
    name = lambda spans: ",".join(f"{secrets.KINDS[k]}:{a}:{z}" for a, k, z in sorted(spans))
    return (*(sum(k == n for _, k, _ in base) for n in range(3)), hashlib.sha256(name(base).encode()).hexdigest(), name(found))


def texts():
    r = random.Random(3)
    key = lambda n: "".join(r.choices(string.ascii_letters + string.digits, k=n))
    hexed = lambda n: "".join(r.choices("0123456789abcdef", k=n))
    out = [None, "", "nothing here", "é😀 token: abcdefgh", "password=short AKIA123", f"API_KEY = '{key(30)}' AKIA{key(16).upper()} {hexed(40)} {hexed(31)}", f"{hexed(64)}{hexed(3)}z {hexed(32)}"]
    for _ in range(60):
        bits = [f"token={key(r.randrange(5, 30))}", f'"secret" : "{hexed(r.randrange(20, 50))}"', "AKIA" + key(r.randrange(8, 20)).upper(), hexed(r.randrange(28, 40)), key(r.randrange(15, 45)), "/usr/local/share/" + key(32), "get_user_account_name", "ünï 😀 wörter"]
        out.append(" ".join(r.choice(bits) for _ in range(r.randrange(1, 12))))
    return out


def test_query(spark, tmp_path):
    made = texts()
    spark.createDataFrame([(i, t, "x") for i, t in enumerate(made)] + [(None, made[5], "x"), (5, made[5], "x")], "doc_id long, text string, found string").write.parquet(str(tmp_path / "documents.parquet"))
    model = list(map(int, secrets.ratios(secrets.labelled_samples(spark)).split(",")))
    rows = queries.op1_secret_scans(spark, str(tmp_path)).collect()
    assert len(rows) == len(made) + 2
    for r in rows:
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) == expected(made[5 if r.doc_id is None else r.doc_id], model)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, con.sql(secrets.oracle_sql()).fetchall()))
    assert sum(r.n_assign > 0 and r.n_hex > 0 for r in rows) > 5 and any("markov" in r.spans for r in rows)


def test_many_matches(spark):
    """A log of 100,000 matches in one text, in time that grows with their number."""
    text = " ".join(f"token={k:032x}" for k in range(50_000))
    began = time.time()
    (row,) = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert len(row.found) == 100_000 and time.time() - began < 60
    assert [(s.start, s.end) for s in row.found[:2]] == [(0, 38), (6, 38)] and row.found[-1].end == len(text)


def test_models_on_held_out_strings(spark):
    """Random strings of Python's generator and identifiers of other words than the samples'."""
    r = random.Random(8)
    alphabets = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits)
    keys = ["".join(r.choices(r.choice(alphabets), k=r.randrange(24, 60))) for _ in range(400)]
    other = "alter bright castle dragon evening forest garden harvest island jungle kitchen lantern meadow northern orchard planet quarter river silver thunder umbrella village winter yellow".split()
    names = [r.choice(("_", "-", "/", "")).join(r.choices(other, k=r.randrange(3, 6))) for _ in range(400)]
    hidden = ["/".join(r.choices(other, k=6)) + "/" + "".join(r.choices(alphabets[0], k=24)) for _ in range(200)]
    found = [r.found for r in secrets.scan(spark.createDataFrame(list(enumerate(keys + names + hidden)), "doc_id long, text string")).orderBy("doc_id").collect()]
    caught = lambda a, z: sum(bool(f) for f in found[a:z]) / (z - a)
    assert caught(0, 400) >= 0.98 and caught(400, 800) <= 0.02 and caught(800, 1000) >= 0.95
