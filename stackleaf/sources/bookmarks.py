"""Bookmark files as rows: Netscape HTML and Chromium JSON, read whole, one file a row, decoded and parsed where the file is read.

A file's folders nest and its time unit is voted on by all its links, so a file is the unit of work; many files spread over tasks.

Defined results: an empty file or one of neither format gives no rows; text that no charset fits is decoded as UTF-8 with replacement marks;
times of no plausible unit are null; links without an address are left out; rows of a file are numbered in file order by ``pos``.
"""

from __future__ import annotations

import codecs
import json
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, pos int, format string, url string, title string, folder_path array<string>, note string, tags array<string>, date_added long, date_modified long"

#: The units in which browsers write times, as (divisor, seconds to take off); the first plausible one counts.
UNITS = {"unix_s": (1, 0), "unix_ms": (1_000, 0), "unix_us": (1_000_000, 0), "webkit_us": (1_000_000, 11_644_473_600)}
#: Plausible times: from 1990 up to 2100.
EARLIEST, LATEST = 631_152_000, 4_102_444_800
BOMS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))


def decode(raw: bytes) -> str:
    """By byte order mark, by the charset named in the first 8,192 bytes, then UTF-8, GB 18030, Windows 1252, and with replacement marks."""
    tries = [name for bom, name in BOMS if raw.startswith(bom)]
    if named := re.search(rb"charset\s*=\s*[\"']?([\w.:-]+)", raw[:8192], re.IGNORECASE):
        name = named[1].decode("ascii").lower()
        tries.append("cp1252" if name == "iso-8859-1" else name)
    for name in [*tries, "utf-8", "gb18030", "cp1252"]:
        try:
            return raw.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
    return raw.decode("utf-8", "replace")


class _Netscape(HTMLParser):
    """Links with their folders: a list that follows a heading is that heading's folder, any other list has no name."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.links: list[dict] = []
        self.folders: list[str | None] = []
        self.heading: str | None = None
        self.taking = ""

    def handle_starttag(self, tag, attrs):
        self.taking = {"a": "title", "h3": "heading", "dd": "note"}.get(tag, "")
        if tag == "dl":
            self.folders.append(self.heading)
            self.heading = None
        elif tag == "h3":
            self.heading = ""
        elif tag == "a":
            own = dict(attrs)
            if not own.get("href"):
                self.taking = ""
                return
            tags = [t.strip() for t in (own.get("tags") or "").split(",") if t.strip()]
            path = [f.strip() for f in self.folders if f is not None]
            self.links.append({"url": own["href"], "title": "", "folder_path": path, "note": "", "tags": tags, "date_added": own.get("add_date"), "date_modified": own.get("last_modified")})

    def handle_endtag(self, tag):
        if tag == "dl" and self.folders:
            self.folders.pop()
        self.taking = ""

    def handle_data(self, data):
        if self.taking == "heading":
            self.heading += data
        elif self.taking and self.links:
            self.links[-1][self.taking] += data


def netscape(text: str) -> list[dict]:
    parser = _Netscape()
    parser.feed(text)
    parser.close()
    for link in parser.links:
        link |= {"title": link["title"].strip(), "note": link["note"].strip() or None}
    return parser.links


def chromium(tree: dict) -> list[dict]:
    """All links under the roots (in order of their keys), depth first; folder_path holds the names above."""
    found, todo = [], [(node, []) for _, node in sorted(tree["roots"].items(), reverse=True) if isinstance(node, dict)]
    while todo:
        node, above = todo.pop()
        if node.get("url") and node.get("type", "url") == "url":
            found.append({"url": node["url"], "title": (node.get("name") or "").strip(), "folder_path": above, "note": None, "tags": [], "date_added": node.get("date_added"), "date_modified": node.get("date_modified") or node.get("date_last_used")})
        path = [*above, node["name"]] if node.get("name") else above
        todo += [(child, path) for child in reversed(node.get("children") or []) if isinstance(child, dict)]
    return found


def parse(text: str) -> tuple[str, list[dict]]:
    """The format and the links of a bookmark file's text."""
    if text.lstrip()[:1] == "{":
        try:
            tree = json.loads(text)
        except ValueError:
            return "unknown", []
        return ("chromium", chromium(tree)) if isinstance(tree.get("roots"), dict) else ("unknown", [])
    if re.search(r"netscape-bookmark-file|<dt>\s*<(a|h3)\b", text, re.IGNORECASE):
        return "netscape", netscape(text)
    return "unknown", []


def in_unit(raw: float, unit: str) -> int | None:
    divisor, less = UNITS[unit]
    seconds = raw / divisor - less
    return int(seconds) if EARLIEST <= seconds < LATEST else None


def unit_of(raw: float) -> str | None:
    return next((unit for unit in UNITS if in_unit(raw, unit) is not None), None)


def seconds(values: list) -> list[int | None]:
    """Times in the unit that most of the values are plausible in; a value that isn't in that one, in its own; else null."""

    def number(v) -> float | None:
        try:
            return float(v)
        except (TypeError, ValueError):
            return None

    numbers = [number(v) for v in values]
    votes = Counter(u for n in numbers if n is not None and (u := unit_of(n)))
    most = max(votes, key=lambda u: (votes[u], -list(UNITS).index(u)), default=None)

    def told(n: float | None) -> int | None:
        if n is None or most is None:
            return None
        own = unit_of(n)
        return in_unit(n, most) if in_unit(n, most) is not None else own and in_unit(n, own)

    return [told(n) for n in numbers]


def rows(path: str, raw: bytes | None) -> list[dict]:
    kind, links = parse(decode(raw or b""))
    added, modified = (seconds([x[c] for x in links]) for c in ("date_added", "date_modified"))
    return [x | {"path": path, "pos": k, "format": kind, "date_added": a, "date_modified": m} for k, (x, a, m) in enumerate(zip(links, added, modified, strict=True))]


def parse_files(files: DataFrame) -> DataFrame:
    """The links of files given as (path, content)."""
    text, names, whole = pa.string(), pa.list_(pa.string()), pa.int64()
    kinds = {"path": text, "pos": pa.int32(), "format": text, "url": text, "title": text, "folder_path": names, "note": text, "tags": names, "date_added": whole, "date_modified": whole}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column("path"), b.column("content"), strict=True):
                yield pa.RecordBatch.from_pylist(rows(path.as_py(), raw.as_py()), pa.schema(kinds.items()))

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read_bookmarks(spark: SparkSession, path: str) -> DataFrame:
    """The links of all bookmark files under ``path``."""
    return parse_files(spark.read.format("binaryFile").load(path))


def warnings_of(path: str, raw: bytes | None) -> list[dict]:
    """What a reader should know of a file: lists that don't close, no links, links without a time, folder names that stand for several paths."""
    text = decode(raw or b"")
    kind, links = parse(text)
    said = []
    if kind == "netscape" and (open_ := len(re.findall(r"<dl\b", text, re.IGNORECASE)) - len(re.findall(r"</dl\b", text, re.IGNORECASE))) > 0:
        said.append(f"{open_} unclosed lists")
    if kind == "unknown":
        said.append("unknown format")
    elif not links:
        said.append("no links")
    if undated := sum(x is None for x in seconds([x["date_added"] for x in links])):
        said.append(f"{undated} links without a plausible time")
    paths: dict[str, set] = {}
    for x in links:
        paths.setdefault(" / ".join(x["folder_path"]), set()).add(tuple(x["folder_path"]))
    said += [f"folder {name!r} stands for {len(p)} paths" for name, p in sorted(paths.items()) if len(p) > 1]
    return [{"path": path, "warning": w} for w in said]


def file_warnings(files: DataFrame) -> DataFrame:
    """(path, warning) of files given as (path, content)."""
    schema = pa.schema([("path", pa.string()), ("warning", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column("path"), b.column("content"), strict=True):
                yield pa.RecordBatch.from_pylist(warnings_of(path.as_py(), raw.as_py()), schema)

    return files.select("path", "content").mapInArrow(run, "path string, warning string")
