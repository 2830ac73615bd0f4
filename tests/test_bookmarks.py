"""Bookmark files: folders, notes, charsets, time units, broken input."""

import json

from stackleaf.sources import bookmarks as B

HTML = """<!DOCTYPE NETSCAPE-Bookmark-file-1>
<DL><p>
  <DT><H3>Recipes &amp; gardens</H3>
  <DL><p>
    <DT><A HREF="https://soup.example/leek?size=4&amp;lid=on" ADD_DATE="1577934245" TAGS="warm, green" ICON="data:image/png;base64,Qk0=">Leeks &lt;and&gt; potatoes</A>
    <DD>Try with thyme
    <DT><H3>菜园</H3>
    <DL><p><DT><A HREF="https://beds.example/" ADD_DATE="1577934300">番茄</A></DL><p>
    <DT><A HREF="https://tools.example/spade" ADD_DATE="4711">Spades</A>
  </DL><p>
  <DT><A HREF="data:text/plain,seed">Loose</A>
  <DT><A>without address</A>
</DL>"""

TREE = {
    "roots": {
        "synced": {"type": "folder", "name": "Phone", "children": [{"type": "url", "name": "map", "url": "https://map.example", "date_added": "13251234567000000"}]},
        "bar": {"type": "folder", "name": "Top", "children": [
            {"type": "folder", "name": "Trips", "children": [{"type": "url", "name": "train", "url": "https://train.example", "date_added": "13251234567000000"}]},
            {"type": "url", "name": "mail", "url": "https://mail.example", "date_added": "12"}]},
        "version": 3,
    }
}


def test_files(spark, tmp_path):
    (tmp_path / "a.html").write_text(HTML, encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps(TREE))
    (tmp_path / "c.html").write_bytes(HTML.encode("gb18030"))
    for name, raw in (("empty", b""), ("broken", b'{"roots": '), ("plain", b"\xff\xfe"), ("list", b"[1]")):
        (tmp_path / name).write_bytes(raw)
    got = {}
    for r in B.read_bookmarks(spark, str(tmp_path)).orderBy("path", "pos").collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    assert sorted(got) == ["a.html", "b.json", "c.html"]
    a = got["a.html"]
    assert [(r.url, r.title, r.folder_path, r.note, r.tags, r.date_added) for r in a] == [
        ("https://soup.example/leek?size=4&lid=on", "Leeks <and> potatoes", ["Recipes & gardens"], "Try with thyme", ["warm", "green"], 1577934245),
        ("https://beds.example/", "番茄", ["Recipes & gardens", "菜园"], None, [], 1577934300),
        ("https://tools.example/spade", "Spades", ["Recipes & gardens"], None, [], None),
        ("data:text/plain,seed", "Loose", [], None, [], None),
    ]
    assert [r[3:] for r in got["c.html"]] == [r[3:] for r in a]
    assert [(r.url, r.folder_path, r.date_added) for r in got["b.json"]] == [
        ("https://train.example", ["Top", "Trips"], 1606760967), ("https://mail.example", ["Top"], None), ("https://map.example", ["Phone"], 1606760967)]
    files = spark.read.format("binaryFile").load(str(tmp_path))
    said = {(r.path.rsplit("/", 1)[1], r.warning) for r in B.file_warnings(files).collect()}
    assert ("a.html", "2 links without a plausible time") in said and ("plain", "unknown format") in said


def test_warnings():
    text = b"<dl><dt><h3>a / b</h3><dl><dt><a href='x:1'>1</a></dl><dt><h3>a</h3><dl><dt><h3>b</h3><dl><dt><a href='x:2'>2</a>"
    said = [w["warning"] for w in B.warnings_of("p", text)]
    assert "3 unclosed lists" in said and "folder 'a / b' stands for 2 paths" in said


def test_units():
    assert B.seconds([1577934245, "1577934246", None, "x", 4711]) == [1577934245, 1577934246, None, None, None]
    assert B.seconds(["1577934245000"]) == [1577934245] and B.seconds(["13251234567000000"]) == [1606760967]
    assert B.seconds([1577934245, 1577934245, 1577934245000]) == [1577934245] * 3
    assert B.seconds([]) == []


def test_decode():
    assert B.decode("é".encode("utf-16")) == "é" and B.decode(b"\xef\xbb\xbfx") == "x"
    assert B.decode(b"<meta charset = iso-8859-1>\x80") == "<meta charset = iso-8859-1>€" and B.decode(b"charset=nonsense x") == "charset=nonsense x"
