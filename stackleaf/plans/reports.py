"""Reports over the library: counts, duplicates, work that is left, comparisons of lists and slices, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..functions import urls
from ..functions import wording as W
from ..operators import evaluation as E
from ..operators import links as K
from ..operators import search as S
from . import search as Q
from . import stores as T
from . import texts as X
from .checks import QUEUE, queue, text
from .more import ADDRESSES, TITLE, addresses, hits, q_cold_whole
from .queries import DOMAINS, FACETS, HEALTH, TARGETS, facets, health, table, targets
from .sessions import edges, edges_sql, grouped

SAVE_WORDS = "saved|bookmark|kept|存|收藏"
TRANSIENT = ("timeout", "temporarily", "refused", "reset")


def q_stats(spark, d):
    """The library's counts, one pass a table."""
    pages = addresses(spark, d).select("page_id", "indexable").join(table(spark, d, "pages").select("page_id", C.host_of(F.col("url")).alias("host")), "page_id")
    private = W.excluded(F.col("host"), X.PRIVATE)
    one = [
        table(spark, d, "documents").agg(F.count("*").alias("bookmarks"), F.count_if(F.coalesce(F.length("text"), F.lit(0)) > 0).alias("with_body"), F.count_if(F.pmod("doc_id", F.lit(3)) != 0).alias("enriched")),
        pages.agg(F.count_if("indexable").alias("indexable"), F.count_if(private).alias("private"), F.countDistinct(F.when(F.col("host") != "", C.registrable_domain(F.col("host")))).alias("domains")),
        table(spark, d, "embeddings").agg(F.count("embedding").alias("vectors"), F.count_if(F.pmod("vec_id", F.lit(4)) == 0).alias("intents_kept")),
        grouped(spark, d).where("session >= 0").agg(F.countDistinct("session").alias("sessions")), edges(spark, d).agg(F.count("*").alias("edges")),
        health(spark, d).agg(F.countDistinct("bookmark_id").alias("checked")), queue(spark, d).agg(F.count_if(F.col("state") == "pending").alias("queued")),
    ]
    out = one[0]
    for x in one[1:]:
        out = out.join(x)  # one row each
    return out


def q_collapsed(spark, d):
    """One row an address: the earliest date, the longest title, the first folder and note that aren't empty, the first spelling of the address; how many
    rows were merged."""
    p = table(spark, d, "pages").join(addresses(spark, d).select("page_id", "url_hash", "indexable"), "page_id")
    rows = p.select("page_id", "url", F.col("url_hash").alias("h"), "indexable", C.html_title(F.col("html")).alias("title"), F.when(F.pmod("page_id", F.lit(2)) == 0, "").otherwise(C.host_of(F.col("url"))).alias("folder"), (F.lit(10**6) - F.col("page_id") * 7 % 1000).alias("date"))
    first = lambda c: F.min_by(c, F.when(F.length(c) > 0, F.col("page_id")).otherwise(F.col("page_id") + 10**9))
    return rows.groupBy(F.col("h").alias("key")).agg(F.count("*").alias("n"), F.min("date").alias("date"), F.max_by("title", F.struct(F.length("title"), -F.col("page_id"))).alias("title"), first("folder").alias("folder"), F.min_by("url", "page_id").alias("url"), F.count_if(~F.col("indexable")).alias("opaque"))


def q_overlap(spark, d):
    """Two facets' top tens: mean likeness, lists without anything in common, half or more in common, and where the second holds the first's leader."""
    found = facets(spark, d)
    per = E.overlap_at(found, "content", "label", 10)
    leader = found.where("facet = 'content' and rank = 1").select("query_id", "doc_id")
    place = leader.join(found.where("facet = 'label'").select("query_id", "doc_id", F.col("rank").alias("place")), ["query_id", "doc_id"], "left")
    a = per.agg(F.count("*").alias("n"), F.round(F.avg("overlap"), 9).alias("mean"), F.count_if(F.col("overlap") == 0).alias("none"), F.count_if(F.col("overlap") >= 0.5).alias("half"))
    return a.join(place.agg(F.count("place").alias("leader_held"), F.min("place").alias("leader_best")))  # one row each


def boosts(spark, d):
    """(query_id, qtype, factor): how much context raised each document of the full list."""
    found = Q.lists(spark, d, facets=("content",))
    base, config = S.fused(found, S.CONFIGS["A"]), S.CONFIGS["A_ctx"]
    raised = S.in_context(base, Q.understood(spark, d), Q.places(spark, d), config).select("query_id", "doc_id", F.col("score").alias("raised"))
    return base.join(raised, ["query_id", "doc_id"]).join(Q.asked(spark, d).select("query_id", "qtype"), "query_id").select("query_id", "doc_id", "qtype", F.round(F.col("raised") / F.col("score"), 4).alias("factor"))


def q_boosts(spark, d):
    """Boosts by type: the share left alone, at the cap, and the median of the others."""
    cap = F.col("factor") >= 1.5999
    return boosts(spark, d).groupBy("qtype").agg(F.count("*").alias("n"), F.round(F.avg((F.col("factor") == 1).cast("int")), 9).alias("alone"), F.round(F.avg(cap.cast("int")), 9).alias("capped"), F.percentile(F.when(F.col("factor") > 1, F.col("factor")), F.lit(0.5)).alias("median"))


def q_round_trip(spark, d):
    """A library beside itself after a round trip that swapped neighbours: top one, overlap at five, lists that differ only by ties."""
    found = facets(spark, d).where("facet = 'content' and rank <= 10")
    moved = found.select("query_id", "doc_id", F.when(F.pmod("query_id", F.lit(100)) == 0, F.col("rank") + F.when(F.pmod("rank", F.lit(2)) == 1, 1).otherwise(-1)).otherwise(F.col("rank")).alias("rank"), F.round("score", 1).alias("score"))
    top = lambda rows: rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("ids"))
    met = top(found).join(top(moved).withColumnRenamed("ids", "other"), "query_id")
    head = lambda c, k: F.slice(F.col(c), 1, k)
    both = F.size(F.array_intersect(head("ids", 5), head("other", 5)))
    same = F.array_sort("ids") == F.array_sort("other")
    return met.agg(F.count("*").alias("n"), F.round(F.avg((F.col("ids")[0] == F.col("other")[0]).cast("int")), 9).alias("top_same"), F.percentile(both, F.lit(0.5)).alias("median_overlap_5"), F.count_if(F.col("ids") == F.col("other")).alias("same"), F.count_if((F.col("ids") != F.col("other")) & same).alias("reordered"), F.count_if(~same).alias("different"))


def q_service_search(spark, d):
    """The other service's search: five pages of documents, as its ids, then the user's own, best first, each id once."""
    page = S.paged(S.fused(Q.lists(spark, d, 50, S.LEXICAL), S.Config("quick", S.LEXICAL)), 50)
    names = X.bookmarks(spark, d).select(F.col("id").alias("doc_id"), F.explode(F.array(F.concat(F.lit("k"), F.col("id").cast("string")), F.concat(F.lit("m"), F.expr("id div 2").cast("string")))).alias("document"), F.concat(F.lit("u"), F.pmod("id", F.lit(3)).cast("string")).alias("user"))
    met = page.join(names, "doc_id").where("user = 'u1'").groupBy("query_id", "document").agg(F.min("place").alias("place"))
    at = F.row_number().over(Window.partitionBy("query_id").orderBy("place", "document")).cast("int")
    return met.withColumn("at", at).where("at <= 10").select("query_id", "document", "at")


def q_sources(spark, d):
    """What an answer would be made from: a query's first sources, and the gaps that show without a model."""
    page = Q.searched(spark, d, "lex_only").where("place <= 5")
    docs = Q.documents(spark, d).select("doc_id", (F.length("body") < 200).alias("thin"), F.length("summary").alias("chars"))
    q = page.join(docs, "doc_id").groupBy("query_id").agg(F.count("*").alias("sources"), F.count_if("thin").alias("thin"), F.sum("chars").alias("chars"))
    gaps = F.array_compact(F.array(F.when(F.col("sources") < 3, "few sources"), F.when(F.col("thin") > 0, "thin sources"), F.when(F.coalesce(F.col("confidence"), F.lit(0.0)) > 0, "asks for a time")))
    return Q.understood(spark, d).select("query_id", "confidence").join(q, "query_id").select("query_id", "sources", "thin", "chars", F.array_join(gaps, ",").alias("gaps"))


def work(spark, d):
    """(id, fetch, enrich, embed): what each bookmark still needs."""
    b = X.q_embedding(spark, d).select("id", "fingerprint", "title_hash").join(X.bookmarks(spark, d).select("id", (F.length("body") > 0).alias("held"), F.md5("body").alias("body_hash")), "id")
    source = F.when(F.pmod("id", F.lit(4)) == 0, "old").when(F.pmod("id", F.lit(9)) == 0, F.lit(None)).otherwise(F.when(F.col("held"), F.col("body_hash")).otherwise(F.col("title_hash")))
    wanted = F.when(F.col("held"), F.col("body_hash")).otherwise(F.col("title_hash"))
    stored = F.when(F.pmod("id", F.lit(3)) != 0, F.when(F.pmod("id", F.lit(7)) == 0, "old").otherwise(F.col("fingerprint")))
    return b.select("id", (~F.col("held")).alias("fetch"), (~source.eqNullSafe(wanted)).alias("enrich"), (~stored.eqNullSafe(F.col("fingerprint"))).alias("embed"))


def q_work(spark, d):
    """A dry run: what each stage would do, and what it would leave as it is."""
    return work(spark, d).agg(F.count("*").alias("n"), *(F.count_if(c).alias(f"would_{c}") for c in ("fetch", "enrich", "embed")), F.count_if(~F.col("enrich")).alias("unchanged"), F.count_if(F.col("embed") & ~F.col("enrich")).alias("stale_vectors"))


def q_untried(spark, d):
    """Bookmarks never checked; of those checked, failures that may pass."""
    tried = health(spark, d).where("id % 4 = 0").select(F.col("bookmark_id").alias("id"), F.element_at(F.array(*map(F.lit, ("read timeout", "HTTP 404", "connection reset", "HTTP 403"))), (F.pmod("id", F.lit(4)) + F.pmod("bookmark_id", F.lit(4)) + 1).cast("int")).alias("error"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    untried = docs.join(tried.select("id").distinct(), "id", "left_anti").agg(F.count("*").alias("untried"))
    return tried.agg(F.count("*").alias("tried"), F.count_if(F.col("error").rlike("|".join(TRANSIENT))).alias("transient")).join(untried)  # one row each


def q_pools(spark, d):
    """Pools of targets with what falls out of each: dead ones with text, ones without text but with words in the title, and the share without text."""
    b = X.bookmarks(spark, d).select("id", F.length("body").alias("chars"), F.size(W.content_tokens(F.col("title"))).alias("words"))
    dead = Q.more.L.latest(health(spark, d)).where("verdict in ('gone', 'drifted')").select(F.col("bookmark_id").alias("id"), F.lit(True).alias("dead"))
    rows = b.join(dead, "id", "left").withColumn("dead", F.coalesce("dead", F.lit(False)))
    thin = F.col("chars") < 200
    return rows.agg(F.count_if(F.col("dead")).alias("dead"), F.count_if(F.col("dead") & thin).alias("dead_without_text"), F.count_if(thin & (F.col("words") >= 2)).alias("thin_named"), F.count_if(thin & (F.col("words") < 2)).alias("thin_unnamed"), F.round(F.avg(thin.cast("int")), 9).alias("share_thin"))


def q_cold_targets(spark, d):
    """How many of the answers are cold, and of the cold how many are answers."""
    t = targets(spark, d).select(F.col("target").alias("bookmark_id")).distinct()
    cold = q_cold_whole(spark, d).select("bookmark_id", F.lit(True).alias("cold"))
    met = t.withColumn("answer", F.lit(True)).join(cold, "bookmark_id", "full_outer")
    return met.agg(F.count("answer").alias("answers"), F.count("cold").alias("cold"), F.count_if(F.col("answer").isNotNull() & F.col("cold").isNotNull()).alias("both"))


def q_slices(spark, d):
    """Two outcomes by slice of the query set: hits of each, gained, lost, and their difference in points; and over all."""
    rows = hits(spark, d).withColumn("slice", F.element_at(F.array(F.lit("year"), F.lit("relative"), F.lit("anchor")), (F.pmod(F.expr("query_id div 50"), F.lit(3)) + 1).cast("int")))
    point = F.round(100 * F.avg(F.col("b").cast("int") - F.col("a").cast("int")), 6)
    return rows.rollup("slice").agg(F.count("*").alias("n"), F.count_if("a").alias("a"), F.count_if("b").alias("b"), F.count_if(F.col("b") & ~F.col("a")).alias("gained"), F.count_if(F.col("a") & ~F.col("b")).alias("lost"), point.alias("points"))


def q_probes(spark, d):
    """Probes of a page's subject in time: what is wrong with each; empty if nothing is."""
    years = X.q_years(spark, d)
    b = X.bookmarks(spark, d).where("date_added is not null").select("id", F.year(F.timestamp_seconds("date_added")).alias("saved")).join(years, "id")
    said = F.concat(F.lit("what was it about "), F.when(F.pmod("id", F.lit(5)) == 0, F.lit("that I saved ")).otherwise(F.lit("")), F.lit("in "), F.when(F.pmod("id", F.lit(7)) == 0, F.col("saved")).otherwise(F.col("subject_year")).cast("string"))
    wrong = F.when(said.rlike(SAVE_WORDS), "save words").when(F.contains(said, F.col("saved").cast("string")), "save year").when(~F.contains(said, F.col("subject_year").cast("string")), "no year").otherwise("")
    return b.select("id", wrong.alias("wrong"))


def q_bound(spark, d):
    """A query file's rows bound to pages by normal address, with their notes; the file asks for every third page in another spelling."""
    asked = table(spark, d, "pages").where("page_id % 3 = 0").select(F.col("page_id").alias("line"), F.concat(F.col("url"), F.when(F.contains("url", F.lit("?")), F.lit("&utm_source=file")).otherwise(F.lit(""))).alias("target_url"))
    known = addresses(spark, d).groupBy("url_norm").agg(F.min("page_id").alias("target_id"))
    met = asked.withColumn("url_norm", urls.normalize(F.col("target_url"))).join(known, "url_norm", "left")
    return met.select("line", F.coalesce("target_id", F.raise_error(F.concat(F.lit("unknown target: "), F.col("target_url"))).cast("long")).alias("target_id"), F.element_at(F.array(F.lit("year"), F.lit("relative"), F.lit("anchor")), (F.pmod("line", F.lit(3)) + 1).cast("int")).alias("note"))


def q_prompts(spark, d):
    """The texts that a model is asked with: known parts or their stand-ins, and the half of the body that a second try takes."""
    none = lambda c: F.when(F.length(c) > 0, F.col(c)).otherwise(F.lit("(none)"))
    b = X.bookmarks(spark, d).select("id", "title", "folder", F.coalesce("url", F.lit("")).alias("url"), "body")
    body = F.when(F.length("body") > 0, F.col("body")).otherwise(F.lit("(no text)"))
    prompt = F.concat(F.lit("Title: "), none("title"), F.lit("\nURL: "), F.col("url"), F.lit("\nFolder: "), none("folder"), F.lit("\n<<<PAGE>>>\n"), body)
    again = F.substr("body", F.lit(1), F.greatest(F.lit(600), F.floor(F.length("body") / 2).cast("int")))
    return b.select("id", F.md5(prompt).alias("prompt"), F.length(again).alias("retry_chars"))


def q_transplant(spark, d):
    """How many embedding texts stay the same when another library's keywords take the place of the own."""
    own = X.q_embedding(spark, d).select("id", "text_md5")
    other = X.bookmarks(spark, d).withColumn("folder", F.when(F.pmod("id", F.lit(3)) == 0, F.concat(F.col("folder"), F.lit("x"))).otherwise(F.col("folder")))
    made = W.embedding_text(F.col("title"), C.snippet(F.col("body"), 200), F.concat(F.array("folder"), X.entities()), F.col("body"))
    return own.join(other.select("id", F.md5(made).alias("other")), "id").agg(F.count("*").alias("n"), F.count_if(F.col("text_md5") == F.col("other")).alias("same"))


def q_facts(spark, d):
    """A page's facts as rows: zeros stay, what is empty or null goes."""
    s = T.q_record(spark, d).select("id", F.expr("stack(5, 'folder', folder, 'chars', cast(chars as string), 'session', cast(session as string), 'intents', intents, 'badge', badge) as (name, value)"))
    return s.where("value is not null and value <> ''").groupBy("name").agg(F.count("*").alias("n"))


def queries():
    return {
        "library_stats": q_stats,
        "duplicate_collapse": q_collapsed,
        "overlap_summary": q_overlap,
        "boost_census": q_boosts,
        "round_trip_verdict": q_round_trip,
        "service_search": q_service_search,
        "answer_sources": q_sources,
        "stage_dry_run": q_work,
        "untried_and_transient": q_untried,
        "target_pools": q_pools,
        "cold_targets": q_cold_targets,
        "slice_deltas": q_slices,
        "probe_validator": q_probes,
        "query_file_bound": q_bound,
        "prompt_texts": q_prompts,
        "transplanted_texts": q_transplant,
        "fact_rows": q_facts,
        "intent_buckets": lambda s, d: K.keep_intents(table(s, d, "embeddings").select(F.expr("vec_id div 3").alias("bookmark_id"), F.col("vec_id").alias("id"), F.when(F.pmod("vec_id", F.lit(13)) > 0, F.pmod("vec_id", F.lit(13))).alias("probe_rank")), 2, 10).groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept")),
    }


SOURCE = "CASE WHEN id % 4 = 0 THEN 'old' WHEN id % 9 = 0 THEN NULL WHEN length(body) > 0 THEN md5(body) ELSE title_hash END"


def oracle_sql():
    from . import more

    e = edges_sql()
    sliced = "([{}])[(query_id // 50 % 3 + 1)::BIGINT]".format("'year', 'relative', 'anchor'")
    ctx = S.Config("A_ctx", ("content",), context=True)
    return {
        "library_stats": f"""WITH {e}, {ADDRESSES.replace('split AS', 'usplit AS', 1).replace('FROM split)', 'FROM usplit)', 1)}, {DOMAINS.replace('split AS', 'dsplit AS', 1).replace('FROM split)', 'FROM dsplit)', 1)}, {HEALTH.replace('log AS', 'checks AS', 1)}, {QUEUE}
            SELECT * FROM (SELECT count(*) AS bookmarks, count(*) FILTER (length(text) > 0) AS with_body, count(*) FILTER (doc_id % 3 <> 0) AS enriched FROM documents), (SELECT count(*) FILTER (indexable) AS indexable FROM addresses),
            (SELECT count(*) FILTER (len(list_filter({list(X.PRIVATE)}, lambda d: host = d OR ends_with(host, '.' || d))) > 0) AS private, count(DISTINCT CASE WHEN host <> '' THEN domain END) AS domains FROM domains),
            (SELECT count(embedding) AS vectors, count(*) FILTER (vec_id % 4 = 0) AS intents_kept FROM embeddings), (SELECT count(DISTINCT session) AS sessions FROM grouped WHERE session >= 0), (SELECT count(*) AS edges FROM edges),
            (SELECT count(DISTINCT bookmark_id) AS checked FROM checks), (SELECT count(*) FILTER (state = 'pending') AS queued FROM queue)""",
        "duplicate_collapse": f"""WITH {ADDRESSES}, t AS (SELECT a.page_id, sha256(url_norm) AS key, indexable, p.url, {TITLE.replace('html', 'p.html')} AS title, CASE WHEN a.page_id % 2 = 0 THEN '' ELSE lower(regexp_extract(p.url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) END AS folder, 1000000 - a.page_id * 7 % 1000 AS date FROM addresses a JOIN pages p USING (page_id))
            SELECT key, count(*) AS n, min(date) AS date, first(title ORDER BY length(title) DESC, page_id) AS title, first(folder ORDER BY length(folder) = 0, page_id) AS folder, arg_min(url, page_id) AS url, count(*) FILTER (NOT indexable) AS opaque FROM t GROUP BY key""",
        "overlap_summary": f"""WITH {FACETS}, per AS ({more.oracle_sql()['overlap_at_k'].split(FACETS + ',', 1)[0]} {FACETS}, {more.oracle_sql()['overlap_at_k'].split(FACETS + ',', 1)[1]}), p AS (SELECT b.rank AS place FROM lists a LEFT JOIN lists b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND b.facet = 'label' WHERE a.facet = 'content' AND a.rank = 1)
            SELECT * FROM (SELECT count(*) AS n, round(avg(overlap), 9) AS mean, count(*) FILTER (overlap = 0) AS none, count(*) FILTER (overlap >= 0.5) AS half FROM per), (SELECT count(place) AS leader_held, min(place) AS leader_best FROM p)""",
        "boost_census": f"""WITH {Q.lists_sql(S.DEPTH, ('content',))}, {Q.LABELS}, {Q.PLACES}, {', '.join(Q.config_sql(ctx, 'c'))}, f AS (SELECT qtype, round(b.score / a.score, 4) AS factor FROM c_0 a JOIN c_1 b USING (query_id, doc_id) JOIN asked USING (query_id))
            SELECT qtype, count(*) AS n, round(avg((factor = 1)::INTEGER), 9) AS alone, round(avg((factor >= 1.5999)::INTEGER), 9) AS capped, quantile_cont(CASE WHEN factor > 1 THEN factor END, 0.5) AS median FROM f GROUP BY qtype""".replace(", f AS (SELECT qtype, round(b", ", ratio AS (SELECT asked.qtype, round(b").replace("FROM f GROUP BY qtype", "FROM ratio GROUP BY qtype"),
        "round_trip_verdict": f"""WITH {FACETS}, a AS (SELECT query_id, list(doc_id ORDER BY rank) AS x, list(doc_id ORDER BY CASE WHEN query_id % 100 = 0 THEN rank + CASE WHEN rank % 2 = 1 THEN 1 ELSE -1 END ELSE rank END) AS y FROM lists WHERE facet = 'content' AND rank <= 10 GROUP BY query_id)
            SELECT count(*) AS n, round(avg((x[1] = y[1])::INTEGER), 9) AS top_same, quantile_cont(len(list_intersect(x[:5], y[:5])), 0.5) AS median_overlap_5, count(*) FILTER (x = y) AS same, count(*) FILTER (x <> y AND list_sort(x) = list_sort(y)) AS reordered, count(*) FILTER (list_sort(x) <> list_sort(y)) AS different FROM a""",
        "service_search": f"""WITH {Q.lists_sql(50, S.LEXICAL)}, {Q.fused_sql(S.Config('quick', S.LEXICAL), 'fused')}, names AS (SELECT id AS doc_id, unnest(['k' || id, 'm' || id // 2]) AS document, 'u' || id % 3 AS user FROM marks),
            held AS (SELECT query_id, document, min(rank) AS place FROM fused JOIN names USING (doc_id) WHERE rank <= 50 AND user = 'u1' GROUP BY ALL), z AS (SELECT query_id, document, row_number() OVER (PARTITION BY query_id ORDER BY place, document)::INTEGER AS "at" FROM held) SELECT * FROM z WHERE "at" <= 10""",
        "answer_sources": f"""WITH {Q.lists_sql(S.DEPTH, S.LEXICAL)}, {Q.LABELS}, {Q.fused_sql(S.CONFIGS['lex_only'], 'fused')}, q AS (SELECT query_id, count(*) AS sources, count(*) FILTER (length(body) < 200) AS thin, sum(length(summary))::BIGINT AS chars FROM fused JOIN docs USING (doc_id) WHERE rank <= 5 GROUP BY query_id)
            SELECT query_id, sources, thin, chars, array_to_string(list_filter([CASE WHEN sources < 3 THEN 'few sources' END, CASE WHEN thin > 0 THEN 'thin sources' END, CASE WHEN confidence > 0 THEN 'asks for a time' END], lambda x: x IS NOT NULL), ',') AS gaps FROM und JOIN q USING (query_id)""",
        "stage_dry_run": f"""WITH {X.EMBED}, w AS (SELECT id, length(body) = 0 AS f, {SOURCE} IS DISTINCT FROM CASE WHEN length(body) > 0 THEN md5(body) ELSE title_hash END AS e, id % 3 = 0 OR id % 7 = 0 AS m FROM marks JOIN embedded USING (id))
            SELECT count(*) AS n, count(*) FILTER (f) AS would_fetch, count(*) FILTER (e) AS would_enrich, count(*) FILTER (m) AS would_embed, count(*) FILTER (NOT e) AS unchanged, count(*) FILTER (m AND NOT e) AS stale_vectors FROM w""",
        "untried_and_transient": f"""WITH {HEALTH}, t AS (SELECT bookmark_id, (['read timeout', 'HTTP 404', 'connection reset', 'HTTP 403'])[(id % 4 + bookmark_id % 4 + 1)::BIGINT] AS error FROM log WHERE id % 4 = 0)
            SELECT * FROM (SELECT count(*) AS tried, count(*) FILTER (regexp_matches(error, '{'|'.join(TRANSIENT)}')) AS transient FROM t), (SELECT count(*) AS untried FROM documents WHERE doc_id NOT IN (SELECT bookmark_id FROM t))""",
        "target_pools": f"""WITH {X.BOOKMARKS}, {HEALTH}, l AS (SELECT bookmark_id, arg_max(verdict, checked_at * 1000000 + id) AS verdict FROM log GROUP BY bookmark_id), b AS (SELECT length(body) < 200 AS thin, len(list_filter({X.toks('title')}, lambda x: x NOT IN {X.listed(W.STOP)} AND NOT regexp_matches(x, {text(W.TIMES)}))) AS words, coalesce(verdict IN ('gone', 'drifted'), false) AS dead FROM marks LEFT JOIN l ON bookmark_id = id)
            SELECT count(*) FILTER (dead) AS dead, count(*) FILTER (dead AND thin) AS dead_without_text, count(*) FILTER (thin AND words >= 2) AS thin_named, count(*) FILTER (thin AND words < 2) AS thin_unnamed, round(avg(thin::INTEGER), 9) AS share_thin FROM b""",
        "cold_targets": f"WITH {TARGETS}, c AS ({more.oracle_sql()['cold_set']}), t AS (SELECT DISTINCT target FROM targets) SELECT (SELECT count(*) FROM t) AS answers, (SELECT count(*) FROM c) AS cold, (SELECT count(*) FROM t WHERE target IN (SELECT bookmark_id FROM c)) AS both",
        "slice_deltas": f"WITH {T.HITS}, s AS (SELECT *, {sliced} AS slice FROM hits) SELECT slice, count(*) AS n, count(*) FILTER (a) AS a, count(*) FILTER (b) AS b, count(*) FILTER (b AND NOT a) AS gained, count(*) FILTER (a AND NOT b) AS lost, round(100 * avg(b::INTEGER - a::INTEGER), 6) AS points FROM s GROUP BY ROLLUP (slice)",
        "probe_validator": f"""WITH years AS ({X.oracle_sql()['subject_years']}), {X.BOOKMARKS}, b AS (SELECT id, year(make_timestamp(date_added * 1000000)) AS saved, subject_year FROM marks JOIN years USING (id) WHERE date_added IS NOT NULL),
            s AS (SELECT *, 'what was it about ' || CASE WHEN id % 5 = 0 THEN 'that I saved ' ELSE '' END || 'in ' || CASE WHEN id % 7 = 0 THEN saved ELSE subject_year END AS said FROM b)
            SELECT id, CASE WHEN regexp_matches(said, '{SAVE_WORDS}') THEN 'save words' WHEN contains(said, saved::VARCHAR) THEN 'save year' WHEN NOT contains(said, subject_year::VARCHAR) THEN 'no year' ELSE '' END AS wrong FROM s""",
        "query_file_bound": f"""WITH {ADDRESSES}, k AS (SELECT url_norm, min(page_id) AS target_id FROM addresses GROUP BY url_norm) SELECT page_id AS line, target_id, (['year', 'relative', 'anchor'])[(page_id % 3 + 1)::BIGINT] AS note FROM addresses JOIN k USING (url_norm) WHERE page_id % 3 = 0""",
        "prompt_texts": f"""WITH {X.BOOKMARKS} SELECT id, md5('Title: ' || CASE WHEN length(title) > 0 THEN title ELSE '(none)' END || chr(10) || 'URL: ' || coalesce(url, '') || chr(10) || 'Folder: ' || CASE WHEN length(folder) > 0 THEN folder ELSE '(none)' END || chr(10) || '<<<PAGE>>>' || chr(10)
            || CASE WHEN length(body) > 0 THEN body ELSE '(no text)' END) AS prompt, length(left(body, greatest(600, length(body) // 2)))::INTEGER AS retry_chars FROM marks""",
        "transplanted_texts": f"WITH {X.BOOKMARKS} SELECT count(*) AS n, count(*) FILTER (id % 3 <> 0) AS same FROM marks",
        "fact_rows": f"""WITH r AS ({T.oracle_sql()['bookmark_records']}), f AS (SELECT unnest(['folder', 'chars', 'session', 'intents', 'badge']) AS name, unnest([folder, chars::VARCHAR, session::VARCHAR, intents, badge]) AS value FROM r) SELECT name, count(*) AS n FROM f WHERE value IS NOT NULL AND value <> '' GROUP BY name""",
        "intent_buckets": """WITH p AS (SELECT vec_id // 3 AS b, vec_id AS id, nullif(vec_id % 13, 0) AS r FROM embeddings), q AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY r NULLS LAST, id) AS place FROM p)
            SELECT CASE WHEN r IS NULL THEN 'not_found' WHEN r = 1 THEN '1' WHEN r <= 3 THEN '2-3' WHEN r <= 10 THEN '4-k' ELSE '>k' END AS bucket, count(*) AS n, count(*) FILTER (r <= 10 AND place <= 2) AS kept FROM q GROUP BY 1""",
    }
