"""Link health as columns: what a status, an error, a page's text and outside observers say about a link."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import body_canonical

#: Text of a page that stands where another was; the first in this order that is found counts.
PLACEHOLDERS = (
    "404", "not found", "no longer available", "no longer exists", "page doesn't exist", "page does not exist", "has been removed", "content unavailable", "this page isn't available",
    "页面不存在", "页面已删除", "内容不存在", "内容已删除", "文章不存在", "笔记不存在", "已被删除", "找不到该页面", "无法访问", "ページが見つかりません",
)
#: Text of a page that is a gate and not the page.
WALLS = (
    "enable javascript", "请开启 javascript", "javascript is required", "verify you are human", "checking your browser", "just a moment", "cf-browser-verification", "access denied",
    "attention required", "unusual traffic", "人机验证", "验证码", "滑动验证", "login to continue", "请登录", "登录后查看", "sign in to continue",
)
#: How sure a conclusion is by itself, and what outside observers add.
BASE = {"alive": 0.95, "gone": 0.80, "soft_gone": 0.60, "drifted": 0.70, "restricted": 0.50, "unreachable": 0.40, "unknown": 0.10}
READER, PROXY, DIVERGENCE, SNAPSHOT, NXDOMAIN = 0.30, 0.25, 0.25, 0.15, 0.10
LOCAL_CAP, DRIFT, SOFT_RATIO = 0.60, 0.60, 0.30
BADGES = {"restricted": "may be region-restricted", "drifted": "content changed", "soft_gone": "page looks emptied", "gone": "link appears dead"}
#: Parts of the error text of a name that can't be resolved.
NO_NAME = ("name or service not known", "nodename nor servname", "temporary failure in name resolution", "getaddrinfo")
CJK = "\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{3040}-\\x{30FF}"


def fetch_verdict(status: Column) -> Column:
    """What a status means for a fetch; null: the page came."""
    return F.when(status.isin(401, 403, 429), "refused").when(status.isin(404, 410), "not_found").when(status >= 500, "server_error").when(status >= 400, "refused")


def local_verdict(status: Column) -> Column:
    """What a status means for a link's health; null: the page came."""
    return F.when(status.isin(404, 410), "gone").when(status.isin(401, 403, 429, 451), "blocked_or_forbidden").when(status >= 500, "unreachable_local").when(status >= 400, "blocked_or_forbidden")


def error_verdict(kind: Column, message: Column) -> Column:
    """What a recorded error (its class and text) means."""
    named = (kind == "ConnectError") & F.lower(message).rlike("|".join(NO_NAME))
    return F.when(named, "dns_fail").otherwise("unreachable")


def error_detail(kind: Column, message: Column) -> Column:
    known = kind.isin("ConnectError", "HTTPError")
    return F.when(known, message).when(kind == "TimeoutException", F.concat(F.lit("timeout: "), message)).when(kind == "TooManyRedirects", "redirect loop").otherwise(F.concat(kind, F.lit(": "), message))


def placeholder(title: Column, body: Column, scan: int = 500) -> Column:
    """The first placeholder text in the title or the start of the body; empty if there is none."""
    hay = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.substring(F.coalesce(body, F.lit("")), 1, scan)))
    return F.coalesce(*(F.when(F.contains(hay, F.lit(p)), p) for p in PLACEHOLDERS), F.lit(""))


def wall(html: Column, body: Column) -> Column:
    """Is the page a gate, or a large document without text?"""
    hay = F.lower(F.concat(F.substring(html, 1, 20_000), F.lit("\n"), F.substring(body, 1, 4000)))
    return hay.rlike("|".join(WALLS)) | ((F.length(html) > 30_000) & (F.length(body) < 120))


def vocabulary(text: Column, most: int = 20_000) -> Column:
    """The distinct words [a-z0-9]+ and CJK pairs of a text's first characters, without what changes at each fetch."""
    t = F.substring(F.lower(body_canonical(text)), 1, most)
    pairs = F.transform(F.regexp_extract_all(t, F.lit(f"[{CJK}]+"), F.lit(0)), lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substr(r, i, F.lit(2)))))
    return F.array_distinct(F.concat(F.regexp_extract_all(t, F.lit("[a-z0-9]+"), F.lit(0)), F.flatten(pairs)))


def alike(a: Column, b: Column) -> Column:
    """The Jaccard similarity of two vocabularies: 1 for two empty ones, 0 for one."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.round(F.when(union == 0, 1.0).otherwise(both / union), 4)


def compared(known_chars: Column, known: Column, known_hash: Column, new: Column, new_hash: Column, title: Column, crashed: Column, similarity: Column) -> Column:
    """What a page that came means beside the text that is known: a crash or nothing known says alive."""
    ratio = F.when(known_chars > 0, F.length(new) / known_chars)
    nothing = (known_chars <= 0) & (F.coalesce(F.length(known), F.lit(0)) == 0)
    emptied = (ratio < SOFT_RATIO) & (placeholder(title, new) != "")
    same = F.coalesce(known_hash, F.lit("")).isin("") | (known_hash != new_hash)
    drifted = same & (F.coalesce(F.length(known), F.lit(0)) > 0) & (similarity < DRIFT)
    return F.when(nothing | crashed, "alive").when(F.coalesce(emptied, F.lit(False)), "soft_gone").when(drifted, "drifted").otherwise("alive")


def dns_answer(json: Column) -> Column:
    """Struct (rcode, addresses) of a resolver's answer; null fields where it gave none."""
    found = F.from_json(json, "Status int, Answer array<struct<type:int,data:string>>")
    listed = F.transform(F.filter(F.coalesce(found["Answer"], F.array().cast("array<struct<type:int,data:string>>")), lambda a: (a["type"] == 1) & (F.coalesce(F.length(a["data"]), F.lit(0)) > 0)), lambda a: a["data"])
    return F.struct(found["Status"].alias("rcode"), listed.alias("addresses"))


def resolvers(answers: Column) -> dict[str, Column]:
    """any_resolved, divergence and agree_nxdomain of an array of ``dns_answer``; answers without a code don't count."""
    usable = F.filter(answers, lambda a: a["rcode"].isNotNull())
    resolved = lambda a: (a["rcode"] == 0) & (F.size(a["addresses"]) > 0)
    against = lambda a: (a["rcode"] == 3) | (~resolved(a) & a["rcode"].isin(0, 2))
    return {
        "any_resolved": F.exists(usable, resolved),
        "divergence": (F.size(usable) >= 2) & F.exists(usable, resolved) & F.exists(usable, against),
        "agree_nxdomain": (F.size(usable) > 0) & F.forall(usable, lambda a: a["rcode"] == 3),
    }


def snapshot_time(stamp: Column) -> Column:
    """Seconds of an archive's stamp yyyyMMddHHmmss (UTC); null if it is none."""
    p = lambda at, n: F.substring(stamp, at, n)
    text = F.concat(p(1, 4), F.lit("-"), p(5, 2), F.lit("-"), p(7, 2), F.lit(" "), p(9, 2), F.lit(":"), p(11, 2), F.lit(":"), p(13, 2))
    return F.when(stamp.rlike("^[0-9]{14}"), F.unix_seconds(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))))


def snapshot(json: Column) -> Column:
    """Struct (url, at) of an archive's closest copy; null fields if there is none."""
    closest = F.from_json(json, "archived_snapshots struct<closest:struct<available:boolean,url:string,timestamp:string>>")["archived_snapshots"]["closest"]
    there = F.coalesce(closest["available"], F.lit(False))
    return F.struct(F.when(there, closest["url"]).alias("url"), F.when(there, snapshot_time(closest["timestamp"])).alias("at"))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(x, 3)))


def synthesized(local: Column, checked: Column, reader: Column, proxy: Column, divergence: Column, resolved: Column, snapshot_after: Column, nxdomain: Column) -> dict[str, Column]:
    """status and confidence: a page that came settles it; else one positive observer outvotes every local failure; else the local view stands."""
    direct = F.when(local.isin("alive", "drifted", "soft_gone"), local).when(local == "skipped", "unknown")
    outside = lambda flag: checked & flag
    failed = local == "dns_fail"
    positive = outside(reader | proxy | divergence | (failed & resolved) | snapshot_after)
    bonus = F.when(outside(reader), READER).when(outside(proxy), PROXY).when(outside(divergence | (failed & resolved)), DIVERGENCE).when(outside(snapshot_after), SNAPSHOT)
    status = F.coalesce(direct, F.when(positive, "restricted").when(local == "gone", "gone").when(local == "blocked_or_forbidden", "restricted").otherwise("unreachable"))
    agreed = F.when(direct.isNull() & ~positive & local.isin("gone", "dns_fail") & nxdomain, NXDOMAIN).otherwise(0.0)
    base = F.element_at(F.create_map(*(F.lit(x) for kv in BASE.items() for x in kv)), status)
    sure = base + F.when(direct.isNull() & positive, bonus).otherwise(agreed)
    return {"status": status, "confidence": clamp(F.when(checked, sure).otherwise(F.least(sure, F.lit(LOCAL_CAP))))}


def badge(status: Column) -> Column:
    out = F.lit("")
    for k, v in BADGES.items():
        out = F.when(status == k, v).otherwise(out)
    return out
