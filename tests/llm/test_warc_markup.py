"""Markup that leaves end tags out, and text payloads that are not HTML."""
import pytest

from haploweave.llm import warc


@pytest.mark.parametrize("page, text, title", [
    ("<html><head><title>T</title><meta charset=x><body><p>one</p>", "one", "T"),
    ("<head><title>T</title><link rel=x><style>p{}</style><div>one</div>", "one", "T"),
    ("<head><title>T</title><body><header>menu</header><p>one</p>", "menu\none", "T"),
    ("<head><script>'</head>'</script><title>T</title></head>one", "one", "T"),
    ("<HEAD><TITLE>T</TITLE></HEAD ><p>one", "one", "T"),
    ("a<noscript>b<p>c", "ab\nc", ""), ("a<iframe src=x>b", "ab", ""), ("a<object>b", "ab", ""), ("a<svg>b", "ab", ""), ("a<template>b", "ab", ""),
    ("a<svg>x</svgs>y</svg>b", "ab", ""), ("a<script>x</scripts>y</script>b", "ab", ""), ("a<style-guide>b", "ab", ""),
    ("a<script>b<p>c", "a", ""), ("a<style>b", "a", ""), ("<title>T<body>one", "one", "T"), ("<title>T", "", "T"),
])
def test_unclosed_elements(page, text, title):
    assert warc.plain_text(page) == (text, title)


def test_many_unclosed_elements_take_linear_time():
    assert warc.plain_text("<svg>x" * 200_000)[0] == "x" * 200_000


@pytest.mark.parametrize("kind", ["text/markdown", "text/csv; charset=utf-8", "text/xml", "Text/Plain"])
def test_text_types_are_converted(kind):
    block = f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\n\r\na <b>, 1".encode()
    made = warc.derive_one("<urn:uuid:1>", "http://x", "", {}, block)
    assert [m["record_type"] for m in made] == ["metadata", "conversion"] and made[1]["block"] == "a <b>, 1"


@pytest.mark.parametrize("kind", ["undefined", "idna", "punycode", "base64", "rot13", "no-such", "utf-8", "latin-1", "utf-16", "x" * 300, "hex", "unicode_escape"])
def test_any_charset_is_read(kind):
    body = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=" + kind + "\r\n\r\n<p>caf\xc3\xa9 \\N{x</p>"
    made = warc.derive_one("<a>", None, "", {}, body.encode("latin-1"))
    assert len(made) == 2 and (made[1]["block"].startswith("caf") or kind == "utf-16")


def test_files_are_read_as_streams(spark, tmp_path):
    """Members, plain files, blocks that hold separators or nothing, junk between records, a cut end."""
    import gzip

    blocks = [b"one", b"", b"a\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\nb\r\n\r\n", b"\xff\x00\r\n\r\n", b"x" * 300_000, "é\n".encode()]
    records = [b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <r%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, len(b), b) for i, b in enumerate(blocks)]
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "members.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "whole.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    for name in ("plain.warc", "members.warc.gz", "whole.warc.gz"):
        got = {r.record_id: bytes(r.block) for r in warc.read(spark, str(tmp_path / name)).collect()}
        assert got == {f"<r{i}>": b for i, b in enumerate(blocks)}
    (tmp_path / "cut.warc").write_bytes(b"".join(records)[: -len(records[-1]) + 70])
    assert warc.read(spark, str(tmp_path / "cut.warc")).count() in (5, 6)
    (tmp_path / "none.warc").write_bytes(b"")
    assert warc.read(spark, str(tmp_path / "none.warc")).count() == 0
