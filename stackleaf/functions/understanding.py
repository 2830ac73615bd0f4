"""What a query asks for, by rules: destinations, exact names, times and vague memories, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns of the rules, written without look-arounds.
QUOTED = "[\"“「『'](.{2,}?)[\"”」』']"
IDENTIFIER = "[a-z]+[A-Z][a-zA-Z]*|[A-Za-z]+_[A-Za-z0-9_]+|\\b[A-Z]{3,}\\b|\\b\\w+\\.(?:py|js|ts|tsx|md|json|yaml|yml|toml|rs|go|java|c|cpp|h|sh)\\b"
URL = "https?://\\S+"
DOMAIN = "(?i)\\b(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\\.)+(?:com|cn|org|net|io|dev|ai|me|co|edu|gov|app|xyz|top|info|so|sh|fm|tv)\\b"
YEAR = "(?:^|[^0-9A-Za-z_])(19[89][0-9]|20[0-4][0-9])(?:$|[^0-9A-Za-z_])"
VAGUE = (
    "那阵子", "那段时间", "那会儿", "那时候", "当时", "刚开始", "最初", "一开始", "同一批", "同时期", "前后", "顺手存的", "一起存",
    "back when", "around the time", "at the time", "same batch", "along with", "when i was",
)
SAVING = ("保存", "收藏", "存的", "存过", "存了", "书签", "上次", "那天", "我存", "saved", "bookmark", "bookmarked", "i kept", "my bookmarks")
#: Fixed values: (pattern, days ago the window starts, days ago it ends); the first that matches counts.
RELATIVE = (
    ("今天|today", 1, 0), ("昨天|yesterday", 2, 0), ("前天", 3, 0), ("这几天|前几天|最近几天|past few days|last few days", 7, 0), ("本周|这周|这个星期|this week", 7, 0), ("上周|上个星期|last week", 14, 5),
    ("这个月|本月|this month", 30, 0), ("上个月|上月|last month", 60, 15), ("最近|recently|lately", 90, 0), ("今年|this year", 365, 0), ("去年|last year", 2 * 365, 0.7 * 365), ("前年", 3 * 365, 1.7 * 365),
)
#: Spelled-out counts, numerals (with the one for ten, up to 99), and the days of the units.
COUNTS = {"a": 1, "an": 1, "one": 1, "couple": 2, "two": 2, "few": 3, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12}
NUMERALS = {"零": 0, "一": 1, "两": 2, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
TEN = "十"
UNITS = {"天": 1, "日": 1, "周": 7, "星期": 7, "月": 30, "年": 365, "day": 1, "days": 1, "week": 7, "weeks": 7, "month": 30, "months": 30, "year": 365, "years": 365}
AGO = "([0-9]{1,3}|[" + "".join(NUMERALS) + TEN + "]{1,3}|\\b(?:" + "|".join(COUNTS) + ")\\b)(?:\\s+of)?\\s*个?\\s*(天|日|周|星期|月|年|days?|weeks?|months?|years?)\\s*(?:前|ago)"


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(words))


def time_window(text: Column, now: int) -> Column:
    """Struct (rule, lo, hi) in seconds, null without a time: a count of units ago, then the relative words, then a year."""
    low, day = F.lower(text), 86400
    lookup = lambda of: F.create_map(*(F.lit(x) for kv in of.items() for x in kv))
    count = F.regexp_extract(low, AGO, 1)
    digit = lambda x, empty: F.when(x == "", empty).otherwise(F.try_element_at(lookup(NUMERALS), x))
    head, tail = F.substring_index(count, TEN, 1), F.substr(count, F.instr(count, TEN) + 1)
    numeral = F.when(F.contains(count, F.lit(TEN)), digit(head, 1) * 10 + digit(tail, 0)).otherwise(F.try_element_at(lookup(NUMERALS), count))
    n = F.greatest(F.coalesce(count.try_cast("int"), F.try_element_at(lookup(COUNTS), count), numeral, F.lit(1)), F.lit(1))
    unit = F.try_element_at(lookup(UNITS), F.regexp_extract(low, AGO, 2)) * day
    half = F.greatest(F.floor(unit / 2), F.lit(day))
    window = lambda rule, lo, hi: F.struct(F.lit(rule).alias("rule"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
    out = F.when(low.rlike(AGO), window("n_ago", F.lit(now) - n * unit - half, F.least(F.lit(now) - n * unit + half, F.lit(now))))
    for pattern, start, end in RELATIVE:
        out = out.when(low.rlike(pattern), window("relative", F.lit(now - start * day), F.lit(int(now - end * day))))
    year = F.regexp_extract(text, YEAR, 1).try_cast("int")
    first = lambda y: F.datediff(F.make_date(y, F.lit(1), F.lit(1)), F.lit("1970-01-01").cast("date")).cast("long") * day
    return out.when(text.rlike(YEAR), window("absolute_year", first(year), first(year + 1)))


def labels(text: Column, now: int) -> dict[str, Column]:
    """Columns: lexical, navigational, episodic, semantic, time_rule, lo, hi, confidence, gate (episodic on more than a bare year), the quoted phrases and the
    rules that held, in their order."""
    t = F.trim(F.coalesce(text, F.lit("")))
    low, when = F.lower(t), time_window(t, now)
    url, vague = t.rlike(URL), any_of(low, VAGUE)
    lexical = t.rlike(QUOTED) | t.rlike(IDENTIFIER) | url
    navigational = url | t.rlike(DOMAIN)
    episodic = when.isNotNull() | vague
    gate = episodic & ((F.coalesce(when["rule"], F.lit("")) != "absolute_year") | vague | any_of(low, SAVING))
    confidence = F.when(when.isNotNull(), 1.0).when(vague, 0.6).otherwise(0.0)
    semantic = (t != "") & ~(navigational & ~lexical & ~episodic)
    phrases = F.transform(F.regexp_extract_all(t, F.lit(QUOTED), F.lit(1)), lambda p: F.btrim(p))
    domain = ~url & t.rlike(DOMAIN)
    rules = (("quoted", t.rlike(QUOTED)), ("identifier", t.rlike(IDENTIFIER)), ("url", url), ("domain", domain))
    held = [F.when(flag, name) for name, flag in rules] + [F.concat(F.lit("time:"), when["rule"]), F.when(vague, "episodic_marker")]
    said = {"phrases": F.array_join(phrases, "|"), "rules": F.array_join(F.array_compact(F.array(*held)), ",")}
    return said | {"lexical": lexical, "navigational": navigational, "episodic": episodic, "semantic": semantic, "time_rule": when["rule"], "lo": when["lo"], "hi": when["hi"], "confidence": confidence, "gate": gate}
