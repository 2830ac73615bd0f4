"""Secret scans with DataFrame functions only: fixed patterns, and character Markov models of random strings and ordinary identifiers.

Two first-order models, one of random strings (keys, digests) and one of ordinary identifiers, are counted from labelled
samples. A token is a run of [A-Za-z0-9+/_=-] of ``least`` characters or more, or such a run of [A-Za-z0-9] within one that isn't random as a
whole (a key behind a path); it is a secret if the log-likelihood ratio, summed over its characters, reaches ``threshold``. The ratios are whole thousandths of a nat, in an array of 128 x 128 (previous and next
character; its size is fixed, so it travels as a literal), and sums of whole numbers don't depend on the order.

Spans are found without positions from the regex engine: the lengths of the matches and of the text between them are written, a row a
document, and added up by windows over a document's matches, in time that grows with their number. Only these numbers are shuffled, never texts,
and a group holds one document's matches, so a hot source or a common text costs nothing more.

Defined results: a null text is empty; a text without spans has "" and its hash; tokens of the model that overlap a base span are left out
(base spans stay); ids are passed on as they are, null or repeated; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: The contract's patterns, in the order of their kinds.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "(?<![0-9a-f])[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")

#: Words that ordinary identifiers are made of.
WORDS = (
    "account action active address admin album amount answer archive article author balance banner batch branch buffer button cache calendar camera cart category change "
    "channel check client cloud column comment company config content context count country create customer data date default delete description design detail device "
    "direction document domain download draft driver email engine entry error event example export feature field file filter folder format forward frame from function "
    "gallery global group handler header health height history home host image import index info input install invoice item journal key label language layout length "
    "level library license limit link list local location login machine manager market master member memory message method mobile model module monitor month name "
    "network news node note number object office option order output owner package page panel parent password path payment person phone photo picture place player "
    "point policy position post price print priority process product profile program project property public query question reader record region release report request "
    "result return review route sample schedule schema screen search section select sensor server service session setting shape share shipping signal size source space "
    "staff start state station status stock storage store stream string style subject summary supplier support switch system table target task team template test text "
    "theme thread ticket time title token tool topic total track training transfer type unit update upload user value vector version video view volume warning weather "
    "website week weight width window work year zone nicht ungen heit keit schaft leistung verein entscheidung einer wissen auch werden durch gegen "
    "ancien besoin cadre dans deux ement etre fait jour leur maison mieux monde nouveau pour quelque tion ancia bueno ciudad cion como cuando desde donde "
    "ella estado gracia hablar mente mundo nuestro para porque tiempo todos usted other there their which would about these thing being through without another "
    "the and ing ion ent her tha nth int ere ter est ers ati hat ate all eth hes ver his oft ith fth sth oth res ont"
)

TOKEN_CHARS, PLAIN_CHARS = "A-Za-z0-9+/_=-", "A-Za-z0-9"
#: Kinds of the models' spans: whole runs, and the runs of letters and digits within those that aren't random as a whole.
RUN, PIECE = 3, 4


def labelled_samples(spark: SparkSession, rows: int = 20_000) -> DataFrame:
    """(label, text): 1 for random strings in the usual encodings, 0 for ordinary identifiers in the usual spellings; made by rule."""
    i = F.col("id")
    raw = F.sha2(F.concat(F.lit("sample"), i.cast("string")), 256)
    b64 = F.rtrim(F.base64(F.unhex(raw)), F.lit("="))
    url = F.translate(b64, "+/", "-_")
    plain = F.translate(b64, "+/", "xQ")
    upper = F.upper(F.translate(b64, "+/", "7K"))
    random = F.element_at(F.array(b64, url, plain, plain, upper, raw, F.substring(raw, 1, 40), F.upper(raw)), (F.pmod(i, F.lit(8)) + 1).cast("int"))
    words = F.split(F.lit(WORDS), " ")

    def drawn(k: int, digits: int = 8) -> Column:
        """A number from a hash that any engine has, so that SQL can make the same samples."""
        return F.conv(F.substring(F.md5(F.concat(i.cast("string"), F.lit(f":{k}"))), 1, digits), 16, 10).cast("long")

    four = [F.get(words, F.pmod(drawn(k), F.size(words)).cast("int")) for k in range(4)]
    number = F.pmod(drawn(9), F.lit(10_000)).cast("string")
    camel = F.concat(four[0], *(F.initcap(w) for w in four[1:]))
    day = F.date_add(F.lit("1990-01-01").cast("date"), F.pmod(i, F.lit(20_000)).cast("int")).cast("string")
    digits = F.rpad(drawn(11, 15).cast("string"), 19, "0")
    same = F.repeat(F.substring(F.lit("-=_+/0aex"), (F.pmod(i, F.lit(9)) + 1).cast("int"), 1), 24)
    forms = [
        F.concat_ws("_", *four), F.concat_ws("_", *four), camel, F.initcap(camel), F.concat_ws("-", *four), F.upper(F.concat_ws("_", *four)), F.concat_ws("/", *four, number),
        F.concat(*four), F.concat(*four), F.concat(*four[:3]), F.upper(F.concat(*four)), F.concat_ws("-", four[0], four[1], day), F.concat_ws("_", four[0], four[1], number), digits, same,
        F.concat_ws("=", four[0], F.concat_ws("-", four[1], number)),
    ]
    ordinary = F.element_at(F.array(*forms), (F.pmod(i, F.lit(len(forms))) + 1).cast("int"))
    ids = spark.range(rows)
    return ids.select(F.lit(1).alias("label"), random.alias("text")).unionByName(ids.select(F.lit(0).alias("label"), ordinary.alias("text")))


def ratios(samples: DataFrame, smoothing: float = 0.5) -> str:
    """The 128 x 128 log-likelihood ratios in whole thousandths, row by row, as comma-joined text. Index 0 as the previous character is the start."""
    chars = F.split("text", "")
    codes = F.concat(F.array(F.lit(0)), F.transform(chars, lambda c: F.ascii(c)))
    steps = samples.where("length(text) > 0").select("label", codes.alias("c")).select("label", F.explode(F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda k: F.get("c", k) * 128 + F.get("c", k + 1))).alias("at"))
    counts = steps.where("at between 0 and 16383").groupBy("at").agg(F.sum("label").alias("r"), F.sum(1 - F.col("label")).alias("o"))
    # 66 characters can follow; the grid holds all previous ones, so that each row has its totals.
    rows = counts.groupBy(F.expr("at div 128").alias("p")).agg(F.sum("r").alias("rt"), F.sum("o").alias("ot"))
    grid = samples.sparkSession.range(16384).withColumnRenamed("id", "at").join(counts, "at", "left").withColumn("p", F.expr("at div 128")).join(rows, "p", "left").na.fill(0)

    def log(n: str, total: str) -> Column:
        return F.log((F.col(n) + smoothing) / (F.col(total) + 66 * smoothing))

    ratio = F.round(1000 * (log("r", "rt") - log("o", "ot"))).cast("int")
    listed = grid.agg(F.array_sort(F.collect_list(F.struct("at", ratio.alias("x")))).alias("m"))
    return listed.select(F.array_join(F.transform("m", lambda e: e["x"].cast("string")), ",")).first()[0]


def _parts(text: Column, pattern: str, kind: int, keep: Callable[[Column, Column], Column], group: int = 0) -> Column:
    """[(kind, pos, gap, size, keep)] of a pattern's matches in order: ``gap`` characters before a match of ``size``. ``keep`` gets the match
    and its ``group``; positions are sums over these rows."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    both = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("b"), found.alias("m"), value.alias("v"))

    def part(x: Column, k: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), k.alias("pos"), F.length(x["b"]).alias("gap"), F.length(x["m"]).alias("size"), keep(x["m"], x["v"]).alias("keep"))

    return F.when(text.rlike(pattern), F.transform(both, part)).otherwise(F.array().cast(PARTS))


PARTS = "array<struct<kind:int,pos:int,gap:int,size:int,keep:boolean>>"


def _ratio(token: Column, model: Column) -> Column:
    codes = F.concat(F.array(F.lit(0)), F.transform(F.split(token, ""), lambda c: F.ascii(c)))
    # zip_with pairs each character with the one before; both arrays are built once.
    steps = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda p, c: F.get(model, p * 128 + c))
    return F.aggregate(steps, F.lit(0), lambda s, x: s + x)


def scan(docs: DataFrame, samples: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", least: int = 20, threshold: float = 14.0) -> DataFrame:
    """(doc_id, found) for every row: ``found`` is [(start, kind, end)] in code points, by start and kind (0-3 as in ``KINDS``)."""
    model = F.split(F.lit(ratios(samples if samples is not None else labelled_samples(docs.sparkSession))), ",").cast("array<int>")
    text, bound = F.col("text"), int(threshold * 1000)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    random = lambda m, _: _ratio(m, model) >= bound
    parts = F.concat(
        _parts(text, ASSIGN, 0, lambda _, v: F.length(v) >= 8, 2), _parts(text, ACCESS, 1, lambda m, _: F.length(m) >= 16), _parts(text, HEX, 2, lambda *_: F.lit(True)),
        _parts(text, f"(?<![{TOKEN_CHARS}])[{TOKEN_CHARS}]{{{least},}}", RUN, random), _parts(text, f"(?<![{PLAIN_CHARS}])[{PLAIN_CHARS}]{{{least},}}", PIECE, random),
    )
    rows = materialize(narrow.select(F.monotonically_increasing_id().alias("row"), "doc_id", parts.alias("parts")), "secret-parts")
    placed = rows.where("exists(parts, x -> x.keep)").select("row", F.inline("parts"))
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "kind").orderBy("pos")).cast("int")
    spans = placed.withColumn("end", end).where("keep").select("row", "kind", (F.col("end") - F.col("size")).alias("start"), "end")
    # Both ways as running values from one end: a frame up to the last row would be summed anew for each row.
    before, after = (Window.partitionBy("row").orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.col("start").asc(), F.col("start").desc()))
    # A span of the models goes where one that comes before it in kind ends behind its start or starts before its end.
    touches = lambda kind: (F.max(F.when(F.col("kind") < kind, F.col("end"))).over(before) > F.col("start")) | (F.min(F.when(F.col("kind") < kind, F.col("start"))).over(after) < F.col("end"))
    judged = spans.withColumns({"run": F.coalesce(touches(RUN), F.lit(False)), "piece": F.coalesce(touches(PIECE), F.lit(False))})
    kept = judged.where(~((F.col("kind") == RUN) & F.col("run")) & ~((F.col("kind") == PIECE) & F.col("piece")))
    listed = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", F.least("kind", F.lit(RUN)).alias("kind"), "end"))).alias("found"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return rows.select("row", "doc_id").join(listed, "row", "left").select("doc_id", F.coalesce("found", none).alias("found"))


def described(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _sql_parts(kind: int, pattern: str, keep: str, group: int = 0) -> str:
    """A pattern's matches (row, kind, pos, gap, size, keep) in SQL."""
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT row, {kind} AS kind, pos, length(g) AS gap, length(m) AS size, {keep} AS keep FROM (SELECT row, unnest(ms) AS m, unnest(vs) AS v, unnest(gs[:len(ms)]) AS g, generate_subscripts(ms, 1) AS pos
        FROM (SELECT row, regexp_extract_all(t, {p}) AS ms, regexp_extract_all(t, {p}, {group}) AS vs, regexp_split_to_array(t, {p}) AS gs FROM d WHERE regexp_matches(t, {p}))), models"""


def oracle_sql(rows: int = 20_000, least: int = 20, threshold: float = 14.0) -> str:
    """The scan of ``documents`` in SQL, with the models' samples, counts and ratios made anew."""
    words = "[" + ", ".join(f"'{w}'" for w in WORDS.split()) + "]"
    drawn = lambda k, n=8: f"('0x' || substr(md5(i || ':{k}'), 1, {n}))::BIGINT"
    a, b, c, e = (f"w{k}" for k in range(4))
    big = lambda w: f"upper({w}[1]) || substr({w}, 2)"
    camel = f"{a} || {big(b)} || {big(c)} || {big(e)}"
    snake = " || '_' || ".join((a, b, c, e))
    forms = (
        snake, snake, camel, f"{big(a)} || substr({camel}, length({a}) + 1)", " || '-' || ".join((a, b, c, e)), f"upper({snake})", " || '/' || ".join((a, b, c, e, "n")), f"{a} || {b} || {c} || {e}", f"{a} || {b} || {c} || {e}", f"{a} || {b} || {c}",
        f"upper({a} || {b} || {c} || {e})", f"{a} || '-' || {b} || '-' || (DATE '1990-01-01' + (i % 20000)::INTEGER)::DATE::VARCHAR", f"{a} || '_' || {b} || '_' || n", f"rpad({drawn(11, 15)}::VARCHAR, 19, '0')", "repeat(substr('-=_+/0aex', i % 9 + 1, 1), 24)", f"{a} || '=' || {b} || '-' || n",
    )
    random = ("x", "translate(x, '+/', '-_')", "translate(x, '+/', 'xQ')", "translate(x, '+/', 'xQ')", "upper(translate(x, '+/', '7K'))", "raw", "left(raw, 40)", "upper(raw)")
    case = lambda options: "CASE " + " ".join(f"WHEN i % {len(options)} = {k} THEN {o}" for k, o in enumerate(options)) + " END"
    drawn_words = ", ".join(f"words[{drawn(k)} % len(words) + 1] AS w{k}" for k in range(4))
    ratio = f"length(m) >= {least} AND list_sum(list_transform(range(1, length(m) + 1), lambda j: model[(CASE WHEN j = 1 THEN 0 ELSE ascii(substr(m, j - 1, 1)) END) * 128 + ascii(substr(m, j, 1)) + 1])) >= {int(threshold * 1000)}"
    touch = lambda low: f"EXISTS (SELECT 1 FROM spans o WHERE o.row = s.row AND o.kind < {low} AND o.a < s.z AND s.a < o.z)"
    named = "(['assign', 'access', 'hex', 'markov', 'markov'])[kind + 1] || ':' || a || ':' || z"
    parts = " UNION ALL ".join(
        (
            _sql_parts(0, ASSIGN, "length(v) >= 8", 2), _sql_parts(1, ACCESS, "length(m) >= 16"), _sql_parts(2, "[0-9a-f]+", "length(m) >= 32"), _sql_parts(RUN, f"[{TOKEN_CHARS}]+", ratio), _sql_parts(PIECE, f"[{PLAIN_CHARS}]+", ratio),
        )
    )
    return f"""WITH made AS (SELECT i, {words} AS words, sha256('sample' || i) AS raw FROM range({rows}) AS r(i)), base AS (SELECT i, raw, rtrim(base64(unhex(raw)), '=') AS x, {drawn_words}, ({drawn(9)} % 10000)::VARCHAR AS n FROM made),
    samples AS (SELECT 1 AS label, {case(random)} AS s FROM base UNION ALL SELECT 0, {case(forms)} FROM base),
    steps AS (SELECT label, unnest(list_transform(range(1, length(s) + 1), lambda j: (CASE WHEN j = 1 THEN 0 ELSE ascii(substr(s, j - 1, 1)) END) * 128 + ascii(substr(s, j, 1)))) AS cell FROM samples),
    counts AS (SELECT cell, sum(label) AS r, sum(1 - label) AS o FROM steps WHERE cell BETWEEN 0 AND 16383 GROUP BY cell), totals AS (SELECT cell // 128 AS p, sum(r) AS rt, sum(o) AS ot FROM counts GROUP BY 1),
    models AS MATERIALIZED (SELECT list(round(1000 * (ln((coalesce(r, 0) + 0.5::DOUBLE) / (coalesce(rt, 0) + 33)) - ln((coalesce(o, 0) + 0.5::DOUBLE) / (coalesce(ot, 0) + 33))))::INTEGER ORDER BY g.cell) AS model FROM range(16384) AS g(cell) LEFT JOIN counts USING (cell) LEFT JOIN totals ON p = g.cell // 128),
    d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents), parts AS ({parts}),
    spans AS MATERIALIZED (SELECT row, kind, z - size AS a, z FROM (SELECT *, sum(gap + size) OVER (PARTITION BY row, kind ORDER BY pos ROWS UNBOUNDED PRECEDING) AS z FROM parts) WHERE keep),
    kept AS (SELECT * FROM spans s WHERE kind < {RUN} OR (kind = {RUN} AND NOT {touch(RUN)}) OR (kind = {PIECE} AND NOT {touch(PIECE)})),
    said AS (SELECT row, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, string_agg({named}, ',' ORDER BY a, kind, z) FILTER (kind < {RUN}) AS b, string_agg({named}, ',' ORDER BY a, least(kind, {RUN}), z) AS every FROM kept GROUP BY row)
    SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(every, '') AS spans FROM d LEFT JOIN said USING (row)"""
