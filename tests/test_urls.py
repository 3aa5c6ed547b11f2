"""References resolved as the standard library does."""

from urllib.parse import urldefrag, urljoin

from pyspark.sql import functions as F

from textloom.functions.html import links_of
from textloom.functions.urls import resolved

BASES = ["http://a/b/c/d?q", "https://h.example.com", "http://h:8080/x/", "http://h/x/y/../z/./w.html?a=/b/../c"]
LINKS = ["g", "./g", "g/", "/g", "//g", "//g/a/../b", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h", "g/../h", "g?y/./x", "g?y/../x", "HTTP://K/p/../q", "mailto:a@b", "a//b/../c"]


def test_resolved(spark):
    rows = spark.createDataFrame([(b, u) for b in BASES for u in LINKS] + [(None, "g"), ("http://a/", None)], "b string, u string")
    wrong = []
    for r in rows.select("b", "u", resolved(F.col("b"), F.col("u")).alias("got")).collect():
        want = None if None in (r.b, r.u) else urldefrag(urljoin(r.b, r.u)).url
        if r.u == "HTTP://K/p/../q":
            want = r.u  # of which the standard library lowers the scheme
        if r.got != want:
            wrong.append((r.b, r.u, r.got, want))
    assert wrong == [], wrong


def test_links_of_pages(spark):
    pages = [
        ("http://a/b/c.html", '<a href="d.html">x</a><a href=\'../e\'>y</a><a href=/f>z</a><a href="#top">t</a><a href="mailto:x@y">m</a>', ["http://a/b/d.html", "http://a/e", "http://a/f"]),
        ("http://a/b/c.html", '<base href="/docs/v1/"><a href="d.html">x</a><meta http-equiv="refresh" content="0; url=../next">', ["http://a/docs/v1/d.html", "http://a/docs/next"]),
        ("http://a/b/", "<META content='5;URL=http://k/' HTTP-EQUIV=Refresh><meta name=refresh content='url=no'>", ["http://k/"]),
        ("http://a/", "", []),
    ]
    df = spark.createDataFrame(pages, "url string, html string, want array<string>")
    assert [(r.got, r.want) for r in df.select(links_of(F.col("html"), F.col("url")).alias("got"), "want").collect() if r.got != r.want] == []
