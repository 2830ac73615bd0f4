"""URL identity as column expressions: the parts of a URL, its tracking parameters and its normal form."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track, by name (lower case) and by prefix.
TRACKING = (
    "fbclid", "gclid", "dclid", "msclkid", "yclid", "twclid", "igshid", "si", "spm", "scm", "ref", "ref_src", "ref_url", "referrer", "from", "from_source", "share_source", "share_medium",
    "share_plat", "share_token", "mkt_tok", "_hsenc", "_hsmi", "hsctatracking", "vero_id", "vero_conv", "mc_cid", "mc_eid", "oly_anon_id", "oly_enc_id", "wt_mc", "trk", "trkcampaign",
    "sourceid", "spref", "xtor", "at_medium", "at_campaign",
)
TRACKING_PREFIX = "^(utm_|pk_|piwik_|matomo_|ga_|_ga)"
#: Hosts whose fragments name different content.
ANCHOR_HOSTS = (
    "github.com", "gist.github.com", "gitlab.com", "stackoverflow.com", "serverfault.com", "superuser.com", "askubuntu.com", "developer.mozilla.org", "docs.python.org", "docs.rs",
    "en.wikipedia.org", "zh.wikipedia.org", "news.ycombinator.com", "groups.google.com", "mail.google.com", "docs.google.com", "web.archive.org",
)
SPLIT = "^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:[?]([^#]*))?(?:#(.*))?$"


#: Characters that a path keeps as they are, beside letters, digits and -._~.
SAFE = "/!$&'()*+,;=:@%"


def decoded(text: Column) -> Column:
    """A query's text without escapes; one that can't be read stays as it is."""
    return F.coalesce(F.try_url_decode(text), text)


def encoded(text: Column) -> Column:
    """A query's text with escapes, a blank as a plus."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def clean_path(path: Column) -> Column:
    """A path with escapes only where they are needed, single slashes and none at the end."""
    plain = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    out = F.replace(F.replace(F.url_encode(plain), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))
    for c in SAFE:
        if c != "*":
            out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    out = F.regexp_replace(F.regexp_replace(out, "/+", "/"), "/$", "")
    return F.when(out == "", "/").otherwise(out)


@dataclass(frozen=True)
class Parts:
    scheme: Column
    host: Column
    port: Column
    path: Column
    pairs: Column
    fragment: Column


def parts(url: Column) -> Parts:
    """The parts of an address; ``pairs`` are structs (k, v) of the query, decoded, empty ones left out."""
    part = lambda k: F.regexp_extract(F.trim(url), SPLIT, k)
    host = F.lower(F.regexp_extract(part(2), "^(?:[^@]*@)?([^:]*)", 1))
    bare = F.when(host.startswith("www.") & (F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) >= 2), F.substring(host, 5, 1 << 20)).otherwise(host)
    pairs = F.transform(F.filter(F.split(part(4), "&"), lambda x: x != ""), lambda x: F.struct(decoded(F.regexp_extract(x, "^([^=]*)", 1)).alias("k"), decoded(F.regexp_extract(x, "^[^=]*=(.*)$", 1)).alias("v")))
    return Parts(F.lower(part(1)), bare, F.regexp_extract(part(2), ":([0-9]+)$", 1), part(3), pairs, part(5))


def tracks(name: Column) -> Column:
    return F.lower(name).isin(*TRACKING) | F.lower(name).rlike(TRACKING_PREFIX)


def indexable(url: Column) -> Column:
    return parts(url).scheme.isin("http", "https")


def kept_fragment(p: Parts) -> Column:
    """A route, or any fragment on a host where fragments name content; else empty."""
    return F.when(p.fragment.rlike("^[!/]") | p.host.isin(*ANCHOR_HOSTS), p.fragment).otherwise("")


def normalize(url: Column) -> Column:
    """One spelling of an address: https, no www., no default port, no tracking parameters, sorted pairs, no trailing slash, and a fragment
    only where it means content. Escapes are read and written anew. Other schemes: the trimmed address."""
    p = parts(url)
    default = F.when(p.scheme == "http", "80").otherwise("443")
    port = F.when((p.port != "") & (p.port != default), F.concat(F.lit(":"), p.port)).otherwise("")
    query = F.array_join(F.transform(F.array_sort(F.filter(p.pairs, lambda x: ~tracks(x["k"]))), lambda x: F.concat(encoded(x["k"]), F.lit("="), encoded(x["v"]))), "&")
    kept = kept_fragment(p)
    whole = F.concat(F.lit("https://"), p.host, port, clean_path(p.path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), F.when(kept != "", F.concat(F.lit("#"), kept)).otherwise(""))
    return F.when(p.scheme.isin("http", "https"), whole).otherwise(F.trim(F.coalesce(url, F.lit(""))))
