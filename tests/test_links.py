"""Reference resolution against the examples of RFC 3986, and links between pages."""

import pytest
from pyspark.sql import functions as F

from paperloom.functions import urls
from paperloom.operators import links, skew

BASE = "http://a/b/c/d;p?q"
# The normal and the abnormal examples of section 5.4.
EXAMPLES = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g",
    "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s",
    ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/",
    "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/",
    "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g",
    "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g",
    "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y",
    "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/./x": "http://a/b/c/g#s/./x",
    "g#s/../x": "http://a/b/c/g#s/../x", "http:g": "http:g",
}


def test_every_example_of_the_standard(spark):
    rows = spark.createDataFrame([(BASE, r) for r in EXAMPLES], "base string, ref string")
    got = {r["ref"]: r["target"] for r in rows.select("ref", urls.resolve(F.col("base"), F.col("ref")).alias("target")).collect()}
    assert got == EXAMPLES


def test_bases_without_path_and_canonical_forms(spark):
    rows = spark.createDataFrame([("http://a", "g"), ("http://a?x", "g"), ("http://a/b", "mailto:X@Y.Z")], "base string, ref string")
    assert [r[0] for r in rows.select(urls.resolve(F.col("base"), F.col("ref"))).collect()] == ["http://a/g", "http://a/g", "mailto:X@Y.Z"]
    forms = {
        "HTTP://User@EXAMPLE.com:80": "http://User@example.com/", "https://a:443/x/../Y?Q#f": "https://a/Y?Q", "https://a:80/": "https://a:80/",
        "http://a:/": "http://a/", "mailto:X@Y.Z": "mailto:X@Y.Z", "": "",
    }
    rows = spark.createDataFrame([(u,) for u in forms], "url string")
    assert {r["url"]: r["c"] for r in rows.select("url", urls.canonical(F.col("url")).alias("c")).collect()} == forms


def page(number, url, *hrefs):
    return number, url, "".join(f'<a href="{h}">x</a>' for h in hrefs)


PAGES = [
    page(1, "http://A.org/", "b/./c", "#top", "http://else.org/x?a=1&amp;b=2", "mailto:me@a.org"),
    page(2, "http://a.org/b/c", "../", "..", "/b/c#here", ""),
    page(3, "http://a.org:80/b/c", "c"),
    page(4, "http://a.org/alone"),
    (5, None, None),
]


@pytest.mark.parametrize("hot", [50_000, 2])
def test_links_lead_to_pages_also_when_a_target_is_hot(spark, monkeypatch, hot):
    monkeypatch.setattr(skew.hot_values, "__defaults__", (0.0, hot))
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    table = links.link_table(pages)
    got = {(r["page_id"], r["position"]): (r["target"], r["fragment"], r["target_page_id"], r["kind"]) for r in table.collect()}
    assert got == {
        (1, 0): ("http://a.org/b/c", "", 2, "page"), (1, 1): ("http://a.org/", "top", 1, "page"),
        (1, 2): ("http://else.org/x?a=1&b=2", "", None, "outside"), (1, 3): ("mailto:me@a.org", "", None, "other"),
        (2, 0): ("http://a.org/", "", 1, "page"), (2, 1): ("http://a.org/", "", 1, "page"), (2, 2): ("http://a.org/b/c", "here", 2, "page"),
        (2, 3): ("http://a.org/b/c", "", 2, "page"), (3, 0): ("http://a.org/b/c", "", 2, "page"),
    }
    degrees = {r[0]: tuple(r)[1:] for r in links.link_degrees(pages, table).collect()}
    assert degrees == {1: (4, 4, 3, 2), 2: (4, 2, 4, 3), 3: (1, 1, 0, 0), 4: (0, 0, 0, 0), 5: (0, 0, 0, 0)}
    assert links.link_table(pages.where("false")).count() == 0
