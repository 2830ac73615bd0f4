"""Link checks, fetches and their queue over the driver tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..functions import health as H
from ..functions import pages as P
from ..operators import library as L
from ..operators import lifecycle as Y
from ..operators import robots as B
from .more import BODY, NOW
from .queries import HEALTH, HOSTS, health, hosts, table

STATUSES = (200, 404, 410, 401, 403, 429, 451, 500, 503, 400, 200, 301)
ERRORS = (
    ("ConnectError", "[Errno -2] Name or service not known"), ("ConnectError", "Connection refused"), ("TimeoutException", "read"), ("TooManyRedirects", "20"), ("HTTPError", "bad gateway"),
    ("ConnectError", "getaddrinfo failed"), ("ValueError", "bad url"),
)
ANSWERS = (
    '{"Status":0,"Answer":[{"type":5,"data":"alias.example"},{"type":1,"data":"192.0.2.7"}]}', '{"Status":3}', '{"Status":2}', '{"Status":0,"Answer":[]}', "not json",
    '{"Status":0,"Answer":[{"type":1,"data":""},{"type":1,"data":"192.0.2.8"},{"type":1,"data":"192.0.2.9"}]}',
)
COPIES = (
    '{"archived_snapshots":{"closest":{"available":true,"url":"http://archive.example/a","timestamp":"20240115093000"}}}', '{"archived_snapshots":{}}',
    '{"archived_snapshots":{"closest":{"available":false,"url":"http://archive.example/b","timestamp":"20240101000000"}}}', '{"archived_snapshots":{"closest":{"available":true,"url":"http://archive.example/c","timestamp":"soon"}}}',
)
LOCALS = ("alive", "gone", "soft_gone", "drifted", "blocked_or_forbidden", "dns_fail", "unreachable_local", "skipped")
FILES = (
    "User-agent: *\nDisallow: /private\nAllow: /private/open # but this\nCrawl-delay: 2\n\nUser-agent: otherbot\nDisallow: /",
    "User-agent: otherbot\nUser-agent: leafbot\nDisallow: /*.php$\nDisallow: /a\nAllow: /a/\nCrawl-delay: 9\n\nUser-agent: *\nDisallow: /\n",
    "Disallow: /lost\nUser-agent: *\nDisallow:\nDisallow: *?q=\nAllow: p",
)
AGENT = "LeafBot/1.0"


def one_of(values, key):
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def events(spark, d):
    return table(spark, d, "events")


def q_statuses(spark, d):
    e = events(spark, d).select("event_id", one_of(STATUSES, F.col("event_id")).alias("status"))
    return e.select("event_id", "status", H.fetch_verdict(F.col("status")).alias("fetch_verdict"), H.local_verdict(F.col("status")).alias("local_verdict"))


def q_errors(spark, d):
    kind, message = one_of([k for k, _ in ERRORS], F.col("event_id")), one_of([m for _, m in ERRORS], F.col("event_id"))
    return events(spark, d).select("event_id", H.error_verdict(kind, message).alias("verdict"), H.error_detail(kind, message).alias("detail"))


def comparisons(spark, d):
    """Each document beside what a later fetch of it might give: itself, another one, a placeholder, its first part, a crash."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("known"))
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("known").alias("other"))
    turn = F.pmod("doc_id", F.lit(6))
    part = F.substr("known", F.lit(1), F.floor(F.length("known") * 4 / 5).cast("int"))
    new = F.when(turn == 0, F.col("known")).when(turn == 1, F.coalesce("other", F.lit(""))).when(turn == 2, F.concat(F.lit("Page Not Found\n"), F.substr("known", F.lit(1), F.lit(20)))).when(turn == 3, part).otherwise(F.lit(""))
    return docs.join(other, "doc_id", "left").select("doc_id", F.when(turn == 5, "").otherwise(F.col("known")).alias("known"), new.alias("new"), (turn == 4).alias("crashed"))


def q_compared(spark, d):
    rows = comparisons(spark, d).withColumns({"a": H.vocabulary(F.col("known")), "b": H.vocabulary(F.col("new"))}).withColumn("similarity", H.alike(F.col("a"), F.col("b")))
    of = lambda c: F.sha2(C.body_canonical(F.col(c)), 256)
    chars = F.length("known")
    verdict = H.compared(chars, F.col("known"), of("known"), F.col("new"), of("new"), F.lit(""), F.col("crashed"), F.col("similarity"))
    return rows.select("doc_id", F.size("a").alias("words"), "similarity", F.round(F.length("new") / F.nullif(chars, F.lit(0)), 4).alias("ratio"), H.placeholder(F.lit(""), F.col("new")).alias("placeholder"), verdict.alias("verdict"))


def reports(spark, d):
    i = F.col("event_id")
    answers = F.array(H.dns_answer(one_of(ANSWERS, i)), H.dns_answer(one_of(ANSWERS, F.expr("event_id div 6"))))
    copy = H.snapshot(one_of(COPIES, i))
    return events(spark, d).select("event_id", C.epoch_seconds(F.col("ts")).alias("failed_at"), answers.alias("answers"), copy.alias("copy"))


def outside(spark, d):
    found = H.resolvers(F.col("answers"))
    rows = reports(spark, d).select("event_id", "failed_at", *(v.alias(k) for k, v in found.items()), F.col("copy.url").alias("copy_url"), F.col("copy.at").alias("copy_at"), F.size(F.flatten(F.col("answers.addresses"))).alias("addresses"))
    return rows.withColumn("copy_after", F.coalesce(F.col("copy_at") >= F.col("failed_at"), F.lit(False)))


def q_synthesis(spark, d):
    i = F.col("event_id")
    said = H.synthesized(one_of(LOCALS, i), F.pmod(i, F.lit(5)) != 0, F.pmod(i, F.lit(7)) == 0, F.pmod(i, F.lit(11)) == 0, F.col("divergence"), F.col("any_resolved"), F.col("copy_after"), F.col("agree_nxdomain"))
    return outside(spark, d).select("event_id", one_of(LOCALS, i).alias("local"), *(v.alias(k) for k, v in said.items()))


def states(spark, d):
    """Each checked bookmark's state."""
    log = health(spark, d)
    runs = L.failure_runs(log).select("bookmark_id", "failures")
    sure = L.confirmed_gone(log).select("bookmark_id", F.lit(True).alias("confirmed"))
    rows = L.latest(log).join(runs, "bookmark_id", "left").join(sure, "bookmark_id", "left")
    failures, confirmed = F.coalesce("failures", F.lit(0)).cast("long"), F.coalesce("confirmed", F.lit(False))
    return rows.select("bookmark_id", "verdict", F.round("confidence", 9).alias("confidence"), "checked_at", confirmed.alias("confirmed"), failures.alias("failures"), F.when(failures > 0, F.col("checked_at") + Y.retry_after(failures)).alias("next_check"), H.badge(F.col("verdict")).alias("badge"), ((F.col("verdict") == "gone") & confirmed).alias("graveyard"))


def due(spark, d, days=30):
    """Documents never checked, or checked longer ago than their backoff (failing) or ``days`` days."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("bookmark_id"), F.coalesce("n_chars", F.lit(0)).alias("known_chars")).join(states(spark, d), "bookmark_id", "left")
    wait = F.when(F.col("failures") > 0, Y.retry_after(F.col("failures"))).otherwise(F.lit(days * 86400))
    return rows.where(F.col("checked_at").isNull() | (F.lit(NOW) - F.col("checked_at") >= wait)).select("bookmark_id", "known_chars", "checked_at", "verdict")


def q_run(spark, d):
    """One sweep: due bookmarks, their local verdicts, what outside observers say of those that fail, and the report by conclusion."""
    probe = due(spark, d, 7).select("bookmark_id").join(q_synthesis(spark, d).withColumnRenamed("event_id", "bookmark_id"), "bookmark_id")
    escalated = F.col("local").isin("gone", "blocked_or_forbidden", "dns_fail", "unreachable_local")
    appended = probe.select("bookmark_id", F.lit(NOW).cast("long").alias("checked_at"), (F.col("bookmark_id") + 10**9).alias("id"), "confidence", F.col("status").alias("verdict"))
    sure = L.confirmed_gone(health(spark, d).select(*appended.columns).unionByName(appended)).select("bookmark_id", F.lit(1).alias("confirmed"))
    return probe.join(sure, "bookmark_id", "left").groupBy("status").agg(F.count("*").alias("n"), F.count_if(escalated).alias("escalated"), F.count("confirmed").alias("confirmed"))


def q_summary(spark, d):
    counted = L.latest(health(spark, d)).groupBy("verdict").agg(F.count("*").alias("n"))
    docs = table(spark, d, "documents").agg(F.count("*").alias("total"))
    unchecked = counted.agg(F.sum("n").alias("checked")).join(docs)  # one row each
    return counted.unionByName(unchecked.select(F.lit("unchecked").alias("verdict"), F.greatest(F.lit(0), F.col("total") - F.coalesce("checked", F.lit(0))).alias("n")))


def q_history(spark, d):
    place = F.row_number().over(Window.partitionBy("bookmark_id").orderBy(F.col("checked_at").desc(), F.col("id").desc()))
    return health(spark, d).withColumn("place", place.cast("int")).where("place <= 3").select("bookmark_id", "id", "verdict", "place")


def q_extraction(spark, d):
    found = P.extracted(F.col("html"))
    rows = table(spark, d, "pages").select("page_id", *(v.alias(k) for k, v in found.items()), P.description(F.coalesce("html", F.lit(""))).alias("about"))
    return rows.select("page_id", "title", "about", "tier", "walled", "usable", F.length("text").alias("chars"), F.md5("text").alias("text_md5"), H.placeholder(F.col("title"), F.col("text")).alias("placeholder"))


def robots(spark, d):
    files = hosts(spark, d).select("host").distinct().select("host", one_of(FILES, F.length("host")).alias("text"))
    return B.rules(files, AGENT)


def paths(spark, d):
    url = F.col("url")
    path = F.concat(F.coalesce(F.nullif(F.regexp_extract(url, "^[a-zA-Z]+://[^/?#]*(/[^?#]*)", 1), F.lit("")), F.lit("/")), F.regexp_extract(url, "^[^?#]*(\\?[^#]*)", 1))
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), C.host_of(url).alias("host"), path.alias("path"), (F.pmod("page_id", F.lit(9)) != 0).alias("reached"))


def q_robots(spark, d):
    return B.decided(paths(spark, d), robots(spark, d)).select("id", "path", "allowed")


def q_schedule(spark, d):
    return B.schedule(paths(spark, d).select("id", "host"), robots(spark, d))


def fetched(spark, d):
    """Fetch results: every fifth page walled, others by status; a body where the page came."""
    rows = events(spark, d).select("event_id", one_of(STATUSES, F.col("event_id")).alias("status"), (F.pmod("event_id", F.lit(5)) == 0).alias("walled"), (F.pmod("event_id", F.lit(13)) == 0).alias("empty"))
    came = F.when(F.col("walled"), "wall").when(F.col("empty"), "empty").otherwise("ok")
    return rows.select("event_id", F.coalesce(H.fetch_verdict(F.col("status")), came).alias("verdict"))


def q_routing(spark, d):
    """Where each result goes: stored and done, or recorded as a failure and, where a browser could do better, queued."""
    v = F.col("verdict")
    return fetched(spark, d).groupBy("verdict").agg(F.count("*").alias("n"), F.count_if(v == "ok").alias("stored"), F.count_if(v != "ok").alias("failed"), F.count_if(v.isin("refused", "wall", "empty", "skipped")).alias("queued"))


def queue(spark, d):
    e = events(spark, d).select(F.col("event_id").alias("id"), "event_type", C.epoch_seconds(F.col("ts")).alias("ts"))
    state = F.when(F.col("event_type") == "click", "leased").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "done").otherwise("pending")
    return e.select("id", state.alias("state"), F.pmod("id", F.lit(4)).alias("attempts"), F.when(F.pmod("id", F.lit(4)) > 0, F.col("ts") + 600).alias("next_attempt_at"), F.when(F.pmod("id", F.lit(3)) == 0, "a body").otherwise(" ").alias("body"))


def q_counts(spark, d, at=1705000000):
    waiting = (F.col("state") == "pending") & (F.col("next_attempt_at") > at)
    c = queue(spark, d).agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("pending", "leased", "done", "failed")), F.count_if(waiting).alias("waiting"))
    return c.withColumn("ready", F.col("pending") - F.least("waiting", "pending"))


def q_finished(spark, d):
    return Y.finish(queue(spark, d).where("state = 'leased'").withColumn("attempts", F.col("attempts").cast("int")), NOW).select("id", "state", "next_attempt_at")


def queries():
    return {
        "http_status_verdicts": q_statuses,
        "error_verdicts": q_errors,
        "local_comparison": q_compared,
        "outside_reports": lambda s, d: outside(s, d).drop("failed_at"),
        "health_synthesis": q_synthesis,
        "health_states": states,
        "due_for_check": due,
        "check_run": q_run,
        "health_latest_summary": q_summary,
        "health_history": q_history,
        "page_extraction": q_extraction,
        "robots_decisions": q_robots,
        "robots_rules": robots,
        "fetch_schedule": q_schedule,
        "fetch_routing": q_routing,
        "queue_counts": q_counts,
        "queue_transitions": q_finished,
    }


def text(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def pick(values, key: str) -> str:
    return f"([{', '.join(map(text, values))}])[({key} % {len(values)} + 1)::BIGINT]"


def placeholder(hay: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({hay}, {text(p)}) THEN {text(p)}" for p in H.PLACEHOLDERS) + " ELSE '' END"


FETCH = "CASE WHEN status IN (401, 403, 429) THEN 'refused' WHEN status IN (404, 410) THEN 'not_found' WHEN status >= 500 THEN 'server_error' WHEN status >= 400 THEN 'refused' END"
LOCAL = "CASE WHEN status IN (404, 410) THEN 'gone' WHEN status IN (401, 403, 429, 451) THEN 'blocked_or_forbidden' WHEN status >= 500 THEN 'unreachable_local' WHEN status >= 400 THEN 'blocked_or_forbidden' END"


def vocabulary(c: str) -> str:
    t = f"left(lower({BODY.replace('text', c)}), 20000)"
    pairs = f"flatten(list_transform(regexp_extract_all({t}, '[{H.CJK}]+'), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END))"
    return f"list_distinct(list_concat(regexp_extract_all({t}, '[a-z0-9]+'), {pairs}))"


COMPARED = f"""docs AS (SELECT doc_id, coalesce(text, '') AS k FROM documents),
    pairs AS (SELECT a.doc_id, a.doc_id % 6 AS turn, CASE WHEN a.doc_id % 6 = 5 THEN '' ELSE a.k END AS known, CASE a.doc_id % 6 WHEN 0 THEN a.k WHEN 1 THEN coalesce(b.k, '')
        WHEN 2 THEN 'Page Not Found' || chr(10) || left(a.k, 20) WHEN 3 THEN left(a.k, floor(length(a.k) * 4 / 5)::BIGINT) ELSE '' END AS new FROM docs a LEFT JOIN docs b ON b.doc_id = a.doc_id + 1),
    sets AS (SELECT *, {vocabulary('known')} AS a, {vocabulary('new')} AS b, sha256({BODY.replace('text', 'known')}) AS kh, sha256({BODY.replace('text', 'new')}) AS nh FROM pairs),
    sized AS (SELECT *, len(list_intersect(a, b)) AS shared FROM sets),
    alike AS (SELECT *, round(CASE WHEN len(a) + len(b) - shared = 0 THEN 1.0::DOUBLE ELSE shared / (len(a) + len(b) - shared) END, 4) AS similarity, length(new) / nullif(length(known), 0) AS r, {placeholder("lower(chr(10) || left(new, 500))")} AS placeholder FROM sized)"""
DNS = "{o}.Status IS NOT NULL"
OUTSIDE = f"""raw AS (SELECT event_id, floor(epoch_us(ts) / 1000000)::BIGINT AS failed_at, {pick(ANSWERS, 'event_id')} AS a1, {pick(ANSWERS, '(event_id // 6)')} AS a2, {pick(COPIES, 'event_id')} AS c FROM events),
    read AS (SELECT *, list_transform([a1, a2], lambda a: CASE WHEN json_valid(a) THEN {{'rcode': (a ->> '$.Status')::INTEGER,
        'n': len(list_filter(from_json(coalesce(a -> '$.Answer', '[]'::JSON), '[{{"type":"INTEGER","data":"VARCHAR"}}]'), lambda x: x.type = 1 AND x.data <> ''))}} ELSE {{'rcode': NULL::INTEGER, 'n': 0}} END) AS answers,
        (c -> '$.archived_snapshots.closest') AS closest FROM raw),
    usable AS (SELECT *, list_filter(answers, lambda a: a.rcode IS NOT NULL) AS u, coalesce((closest ->> '$.available') = 'true', false) AS there FROM read),
    seen AS (SELECT *, len(list_filter(u, lambda a: a.rcode = 0 AND a.n > 0)) AS good, len(list_filter(u, lambda a: a.rcode = 3)) AS none,
        len(list_filter(u, lambda a: a.rcode = 3 OR (a.rcode IN (0, 2) AND NOT (a.rcode = 0 AND a.n > 0)))) AS against,
        CASE WHEN there THEN closest ->> '$.url' END AS copy_url, CASE WHEN there AND regexp_matches(closest ->> '$.timestamp', '^[0-9]{{14}}') THEN epoch(strptime(left(closest ->> '$.timestamp', 14), '%Y%m%d%H%M%S'))::BIGINT END AS copy_at FROM usable),
    outside AS (SELECT event_id, good > 0 AS any_resolved, len(u) >= 2 AND good > 0 AND against > 0 AS divergence, len(u) > 0 AND none = len(u) AS agree_nxdomain, copy_url, copy_at,
        list_sum(list_transform(answers, lambda a: a.n))::INTEGER AS addresses, coalesce(copy_at >= failed_at, false) AS copy_after FROM seen)"""
SYNTHESIS = f"""{OUTSIDE}, flags AS (SELECT *, {pick(LOCALS, 'event_id')} AS local, event_id % 5 <> 0 AS checked, event_id % 7 = 0 AS reader, event_id % 11 = 0 AS proxy FROM outside),
    outs AS (SELECT *, CASE WHEN NOT checked THEN NULL WHEN reader THEN 0.30::DOUBLE WHEN proxy THEN 0.25::DOUBLE WHEN divergence OR (local = 'dns_fail' AND any_resolved) THEN 0.25::DOUBLE WHEN copy_after THEN 0.15::DOUBLE END AS bonus FROM flags),
    ruled AS (SELECT *, CASE WHEN local IN ('alive', 'drifted', 'soft_gone') THEN local WHEN local = 'skipped' THEN 'unknown' WHEN bonus IS NOT NULL THEN 'restricted' WHEN local = 'gone' THEN 'gone' WHEN local = 'blocked_or_forbidden' THEN 'restricted' ELSE 'unreachable' END AS status FROM outs),
    sure AS (SELECT *, CASE status WHEN 'alive' THEN 0.95::DOUBLE WHEN 'gone' THEN 0.80::DOUBLE WHEN 'soft_gone' THEN 0.60::DOUBLE WHEN 'drifted' THEN 0.70::DOUBLE WHEN 'restricted' THEN 0.50::DOUBLE WHEN 'unreachable' THEN 0.40::DOUBLE ELSE 0.10::DOUBLE END
        + CASE WHEN local IN ('alive', 'drifted', 'soft_gone', 'skipped') THEN 0.0::DOUBLE WHEN bonus IS NOT NULL THEN bonus WHEN local IN ('gone', 'dns_fail') AND agree_nxdomain THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END AS raw FROM ruled),
    said AS (SELECT event_id, local, status, greatest(0.0::DOUBLE, least(1.0::DOUBLE, round(CASE WHEN checked THEN raw ELSE least(raw, 0.60::DOUBLE) END, 3))) AS confidence FROM sure)"""
STATES = f"""{HEALTH}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bookmark_id ORDER BY checked_at DESC, id DESC) AS r FROM log) WHERE r = 1),
    g AS (SELECT *, sum((verdict NOT IN ('gone', 'unreachable'))::INTEGER) OVER (PARTITION BY bookmark_id ORDER BY checked_at DESC, id DESC) AS good FROM log), f AS (SELECT bookmark_id, count(*) AS failures FROM g WHERE good = 0 GROUP BY bookmark_id),
    c AS (SELECT bookmark_id FROM log WHERE verdict = 'gone' AND confidence >= 0.75 GROUP BY bookmark_id HAVING count(*) >= 2 AND max(checked_at) - min(checked_at) >= 604800),
    states AS (SELECT last.bookmark_id, verdict, round(confidence, 9) AS confidence, checked_at, c.bookmark_id IS NOT NULL AS confirmed, coalesce(failures, 0) AS failures,
        CASE WHEN failures > 0 THEN checked_at + least(86400 * pow(2, least(failures, 20) - 1), 2592000)::BIGINT END AS next_check, CASE verdict {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in H.BADGES.items())} ELSE '' END AS badge, verdict = 'gone' AND c.bookmark_id IS NOT NULL AS graveyard
        FROM last LEFT JOIN f USING (bookmark_id) LEFT JOIN c ON c.bookmark_id = last.bookmark_id)"""
DUE = STATES + """, due AS (SELECT doc_id AS bookmark_id, coalesce(n_chars, 0) AS known_chars, checked_at, verdict FROM documents LEFT JOIN states ON doc_id = bookmark_id
    WHERE checked_at IS NULL OR 1706745600 - checked_at >= CASE WHEN failures > 0 THEN next_check - checked_at ELSE {days} * 86400 END)"""


def cleaned(x: str) -> str:
    x = f"regexp_replace(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), '[ \\t\\x{{00A0}}]+', ' ', 'g')".replace("{{", "{").replace("}}", "}")
    return f"trim(regexp_replace(array_to_string(list_transform(string_split({x}, chr(10)), lambda x: trim(x, ' ')), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))".replace("{{", "{").replace("}}", "}")


def unescaped(x: str) -> str:
    for name, char in P.REFERENCES:
        x = f"replace({x}, {text(name)}, {text(char)})"
    return x


def stripped(x: str) -> str:
    return f"trim({unescaped(f'''regexp_replace({x}, '<[^>]+>', ' ', 'g')''')}, ' ')"


VISIBLE = "h"
for _t in P.SILENT:
    VISIBLE = f"regexp_replace({VISIBLE}, '(?is)<{_t}[\\s>].*?</{_t}\\s*>', ' ', 'g')"
VISIBLE = cleaned(unescaped(f"regexp_replace(regexp_replace({VISIBLE}, {text(P.BREAKS)}, chr(10), 'g'), '<[^>]+>', ' ', 'g')"))
TITLE = f"regexp_replace({stripped('''regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1)''')}, '[ \\t\\x{{00A0}}]+', ' ', 'g')".replace("{{", "{").replace("}}", "}")
ABOUT = stripped(f"CASE WHEN regexp_matches(h, {text(P.DESCRIPTION)}) THEN regexp_extract(h, {text(P.DESCRIPTION)}, 1) ELSE regexp_extract(h, {text(P.REVERSED)}, 1) END")
WALLED = "regexp_matches(lower(left(h, 20000) || chr(10) || left(text, 4000)), " + text("|".join(H.WALLS)) + ") OR (length(h) > 30000 AND length(text) < 120)"
EXTRACTED = f"""page AS (SELECT page_id, coalesce(html, '') AS h FROM pages), parts AS (SELECT *, {VISIBLE} AS body, {TITLE} AS title, {ABOUT} AS about FROM page),
    metas AS (SELECT *, {cleaned("concat_ws(chr(10), nullif(title, ''), nullif(about, ''))")} AS meta FROM parts),
    chosen AS (SELECT *, length(body) >= 200 OR length(body) > length(meta) AS use FROM metas), texts AS (SELECT *, CASE WHEN use THEN body ELSE meta END AS text FROM chosen),
    judged AS (SELECT *, {WALLED} AS walled FROM texts)"""
ROBOTS = f"""{HOSTS}, files AS (SELECT DISTINCT host, {pick(FILES, 'length(host)')} AS text FROM hosts),
    lines AS (SELECT host, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM files),
    bare AS (SELECT host, pos, trim(split_part(raw, '#', 1), ' ' || chr(9)) AS line FROM lines), fields AS (SELECT host, pos, lower(trim(left(line, instr(line, ':') - 1))) AS field, trim(substr(line, instr(line, ':') + 1), ' ' || chr(9)) AS value FROM bare WHERE contains(line, ':')),
    begun AS (SELECT *, (field = 'user-agent' AND coalesce(lag(field) OVER (PARTITION BY host ORDER BY pos) <> 'user-agent', true))::INTEGER AS s FROM fields),
    rec AS (SELECT * FROM (SELECT *, sum(s) OVER (PARTITION BY host ORDER BY pos) AS grp FROM begun) WHERE grp > 0),
    groups AS (SELECT host, grp, bool_or(value <> '*' AND contains('{AGENT.lower()}', lower(value))) AS named, bool_or(value = '*') AS wild FROM rec WHERE field = 'user-agent' GROUP BY host, grp),
    own AS (SELECT rec.*, named, wild, bool_or(named) OVER (PARTITION BY host) AS saw FROM rec JOIN groups USING (host, grp) WHERE field <> 'user-agent' AND (named OR wild)),
    used AS (SELECT * FROM own WHERE CASE WHEN saw THEN named ELSE wild END),
    rules AS (SELECT host, field = 'allow' AS allow, CASE WHEN starts_with(value, '/') THEN value ELSE '/' || value END AS pattern, NULL::DOUBLE AS delay FROM used WHERE field IN ('allow', 'disallow') AND value <> ''
        UNION ALL SELECT host, NULL, NULL, arg_max(try_cast(value AS DOUBLE), pos) FROM used WHERE field = 'crawl-delay' AND try_cast(value AS DOUBLE) IS NOT NULL GROUP BY host)"""
PATHS = """paths AS (SELECT page_id AS id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host, page_id % 9 <> 0 AS reached,
    coalesce(nullif(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*(/[^?#]*)', 1), ''), '/') || regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) AS path FROM pages)"""
REGEX = "'^' || replace(regexp_replace(CASE WHEN ends_with(pattern, '$') THEN left(pattern, length(pattern) - 1) ELSE pattern END, '([.+?^${}()|\\[\\]\\\\])', '\\\\\\1', 'g'), '*', '.*') || CASE WHEN ends_with(pattern, '$') THEN '$' ELSE '' END"
FETCHED = f"""res AS (SELECT event_id, {pick(STATUSES, 'event_id')} AS status FROM events), fetched AS (SELECT event_id, coalesce({FETCH}, CASE WHEN event_id % 5 = 0 THEN 'wall' WHEN event_id % 13 = 0 THEN 'empty' ELSE 'ok' END) AS verdict FROM res)"""
QUEUE = """queue AS (SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'leased' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'done' ELSE 'pending' END AS state, event_id % 4 AS attempts,
    CASE WHEN event_id % 4 > 0 THEN floor(epoch_us(ts) / 1000000)::BIGINT + 600 END AS next_attempt_at, event_id % 3 = 0 AS got FROM events)"""


def oracle_sql():
    return {
        "http_status_verdicts": f"WITH s AS (SELECT event_id, {pick(STATUSES, 'event_id')} AS status FROM events) SELECT event_id, status, {FETCH} AS fetch_verdict, {LOCAL} AS local_verdict FROM s",
        "error_verdicts": f"""WITH s AS (SELECT event_id, {pick([k for k, _ in ERRORS], 'event_id')} AS k, {pick([m for _, m in ERRORS], 'event_id')} AS m FROM events)
            SELECT event_id, CASE WHEN k = 'ConnectError' AND regexp_matches(lower(m), '{'|'.join(H.NO_NAME)}') THEN 'dns_fail' ELSE 'unreachable' END AS verdict,
            CASE WHEN k IN ('ConnectError', 'HTTPError') THEN m WHEN k = 'TimeoutException' THEN 'timeout: ' || m WHEN k = 'TooManyRedirects' THEN 'redirect loop' ELSE k || ': ' || m END AS detail FROM s""",
        "local_comparison": f"""WITH {COMPARED} SELECT doc_id, len(a)::INTEGER AS words, similarity, round(r, 4) AS ratio, placeholder, CASE WHEN length(known) = 0 OR turn = 4 THEN 'alive'
            WHEN r < 0.30 AND placeholder <> '' THEN 'soft_gone' WHEN kh <> nh AND similarity < 0.60 THEN 'drifted' ELSE 'alive' END AS verdict FROM alike""",
        "outside_reports": f"WITH {OUTSIDE} SELECT * FROM outside",
        "health_synthesis": f"WITH {SYNTHESIS} SELECT * FROM said",
        "health_states": f"WITH {STATES} SELECT * FROM states",
        "due_for_check": f"WITH {DUE.format(days=30)} SELECT * FROM due",
        "check_run": f"""WITH {DUE.format(days=7)}, {SYNTHESIS}, probe AS (SELECT due.bookmark_id, local, status, said.confidence FROM due JOIN said ON event_id = due.bookmark_id),
            logs AS (SELECT bookmark_id, checked_at, verdict, confidence FROM log UNION ALL SELECT bookmark_id, 1706745600, status, confidence FROM probe),
            k AS (SELECT bookmark_id FROM logs WHERE verdict = 'gone' AND confidence >= 0.75 GROUP BY bookmark_id HAVING count(*) >= 2 AND max(checked_at) - min(checked_at) >= 604800)
            SELECT status, count(*) AS n, count(*) FILTER (local IN ('gone', 'blocked_or_forbidden', 'dns_fail', 'unreachable_local')) AS escalated, count(k.bookmark_id) AS confirmed FROM probe LEFT JOIN k USING (bookmark_id) GROUP BY status""",
        "health_latest_summary": f"""WITH {STATES} SELECT verdict, count(*) AS n FROM last GROUP BY verdict
            UNION ALL SELECT 'unchecked', greatest(0, (SELECT count(*) FROM documents) - (SELECT count(*) FROM last))""",
        "health_history": f"WITH {HEALTH}, h AS (SELECT *, row_number() OVER (PARTITION BY bookmark_id ORDER BY checked_at DESC, id DESC)::INTEGER AS place FROM log) SELECT bookmark_id, id, verdict, place FROM h WHERE place <= 3",
        "page_extraction": f"""WITH {EXTRACTED} SELECT page_id, title, about, CASE WHEN use THEN 'body' WHEN meta <> '' THEN 'metadata' ELSE 'none' END AS tier, walled, length(text) >= 200 AND NOT walled AS usable, length(text)::INTEGER AS chars, md5(text) AS text_md5,
            {placeholder("lower(title || chr(10) || left(text, 500))")} AS placeholder FROM judged""",
        "robots_decisions": f"""WITH {ROBOTS}, {PATHS}, met AS (SELECT id, arg_max(allow, length(pattern) * 2 + allow::INTEGER) AS allow FROM paths JOIN (SELECT *, {REGEX} AS regex FROM rules WHERE pattern IS NOT NULL) USING (host) WHERE reached AND regexp_matches(path, regex) GROUP BY id)
            SELECT id, path, coalesce(allow, true) AS allowed FROM paths LEFT JOIN met USING (id)""",
        "robots_rules": f"WITH {ROBOTS} SELECT * FROM rules",
        "fetch_schedule": f"""WITH {ROBOTS}, {PATHS}, slow AS (SELECT host, least(delay, 5.0::DOUBLE) AS delay FROM rules WHERE pattern IS NULL AND delay > 0)
            SELECT id, host, round((row_number() OVER (PARTITION BY host ORDER BY id) - 1) * greatest(coalesce(delay, 0.5::DOUBLE), 0.5::DOUBLE), 6) AS starts_at FROM paths LEFT JOIN slow USING (host)""",
        "fetch_routing": f"WITH {FETCHED} SELECT verdict, count(*) AS n, count(*) FILTER (verdict = 'ok') AS stored, count(*) FILTER (verdict <> 'ok') AS failed, count(*) FILTER (verdict IN ('refused', 'wall', 'empty', 'skipped')) AS queued FROM fetched GROUP BY verdict",
        "queue_counts": f"""WITH {QUEUE}, c AS (SELECT count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'leased') AS leased, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'failed') AS failed,
            count(*) FILTER (state = 'pending' AND next_attempt_at > 1705000000) AS waiting FROM queue) SELECT *, pending - least(waiting, pending) AS ready FROM c""",
        "queue_transitions": f"""WITH {QUEUE} SELECT id, CASE WHEN got THEN 'done' WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END AS state,
            CASE WHEN NOT got AND attempts < 3 THEN 1706745600 + CASE WHEN attempts <= 1 THEN 300 WHEN attempts = 2 THEN 1800 ELSE 7200 END END::BIGINT AS next_attempt_at FROM queue WHERE state = 'leased'""",
    }
