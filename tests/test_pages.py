"""The HTML tokenizer against the standard library's parser, and on markup that patterns misread."""

import random
import re
from html.parser import HTMLParser

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tidewell.sources import html as H


class Plain(HTMLParser):
    """Texts outside scripts and styles, links, and how often each tag starts: nothing of the element stack."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.texts, self.links, self.tags, self.skip, self.run = [], [], [], None, ""

    def flush(self):
        if text := re.sub(r"\s+", " ", self.run).strip():
            self.texts.append(text)
        self.run = ""

    def handle_starttag(self, tag, attrs):
        self.flush()
        self.tags.append(tag)
        self.skip = tag if tag in ("script", "style") else self.skip
        if tag == "a" and dict(attrs).get("href") is not None:
            self.links.append(dict(attrs)["href"])

    def handle_endtag(self, tag):
        self.flush()
        self.skip = None if tag == self.skip else self.skip

    def handle_comment(self, data):
        self.flush()

    handle_decl = handle_comment

    def handle_data(self, data):
        if not self.skip:
            self.run += data


def plain(html):
    parser = Plain()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser


def test_given_pages_as_the_library_reads_them():
    for html in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist():
        page, want = H.Page(html), plain(html)
        assert page.texts == want.texts
        assert [e[0] for e in page.elements] == want.tags
        assert [e[1]["href"] for e in page.elements if e[0] == "a"] == want.links
        article = re.sub(r"(?s)<(script|style)>.*?</\1>|<!--.*?-->", " ", html).split("<article>")[1].split("</article>")[0]
        assert page.content() == " ".join(plain(article).texts)


def test_random_markup():
    rng = random.Random(4)
    parts = ["<p>", "</p>", "<b>", "</b>", "<div class='x y'>", "</div>", "<br>", "<br/>", "<ul><li>", "<li>", "</ul>", "text ", " a&amp;b ", "&lt;i&gt;", "<!-- <p>no</p> -->", "<script>'</p><b>'</script>", "<STYLE>p>b</STYLE>", '<a href="/x?a=1&amp;b=2">', "<a href=y>", "</a>", "<h3>", "</h3>", "<td>", "<tr>", "<table>", "</table>", "é "]
    for _ in range(2000):
        html = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        page, want = H.Page(html), plain(html)
        assert page.texts == want.texts and [e[0] for e in page.elements] == want.tags
        assert [e[1]["href"] for e in page.elements if e[0] == "a"] == want.links
        assert all(0 <= lo <= hi <= len(page.texts) for _, _, lo, hi in page.elements)


def test_open_elements_are_ended():
    page = H.Page("<body><p>one<p>two <b>bold<div>three<ul><li>four<li>five<ul><li>six</ul><li>seven</ul></div><table><tr><td>a<td>b<tr><td>c</table><dl><dt>d<dd>e<dt>f</dl>")
    found = [(e[0], page.text_of(e)) for e in page.elements if e[0] in ("p", "li", "td", "tr", "dt", "dd")]
    assert found == [("p", "one"), ("p", "two bold"), ("li", "four"), ("li", "five six"), ("li", "six"), ("li", "seven"), ("tr", "a b"), ("td", "a"), ("td", "b"), ("tr", "c"), ("td", "c"), ("dt", "d"), ("dd", "e"), ("dt", "f")]


def test_pairs():
    pairs = lambda html: dict(H.Page(html).pairs("h2", ("h3",)))
    assert pairs("<h3>Before</h3><p>no</p><h2>t</h2><h3>A</h3><p></p><h3>B</h3><div><span>1</span> 2</div><p>3</p><h3>B</h3><p>4</p><h3>Amenities</h3><p>x</p><h3>C</h3><p>5</p>") == {"B": "1 2"}
    assert pairs("<h2>t</h2><h3>A</h3><p>A</p><p>b</p><h2>next</h2><h3>C</h3><p>c</p>") == {"A": "b"}
    assert pairs("<b>Housing Type</b> house <i>Utilities</i><i>extra</i>") == {"Housing Type": "house", "Utilities": "extra"}
    assert pairs("") == pairs("no markup") == {}


def test_unfinished_markup():
    for html in ("<p>a <!-- b", "<p>a <script>b", "<p>a <a href='b", "<p>a <b", "<p>a </p", "<p>a &am"):
        assert H.Page(html).texts[0].startswith("a")
    assert H.Page("1 < 2 & 3 > 2").texts == ["1 < 2 & 3 > 2"]
    assert H.Page("<title>a <b> &amp; c</title><p>d").texts == ["a <b> & c", "d"]


def test_rows(spark):
    html = '<html lang=fr><title>t</title><nav>home</nav><div class="ad">buy</div><main>own <a href=/x>link</a></main><footer>f</footer>'
    rows = spark.createDataFrame([(1, html, 5), (2, None, 6), (None, "", 7), (1, "x" * 100_000, 8)], "id long, html string, page int")
    got = [(r.id, r.page.text and r.page.text[:20], r.page.language, r.page.title, len(r.page.links)) for r in H.parse_pages(rows, "id").collect()]
    assert got == [(1, "own link", "fr", "t", 1), (2, None, None, None, 0), (None, None, None, None, 0), (1, "x" * 20, None, None, 0)]
    assert H.parse_pages(rows.where("false"), "id").collect() == []


def test_addresses(spark):
    rows = spark.createDataFrame([("https://h.ex/a/b?c", t) for t in ("d.png", "/d.png#x", "//e.ex/d", "http://f.ex", "mailto:a")] + [("https://h.ex", "d")], "url string, t string")
    got = [r[0] for r in rows.select(H.absolute(F.col("url"), F.col("t"))).collect()]
    assert got == ["https://h.ex/a/d.png", "https://h.ex/d.png", "https://e.ex/d", "http://f.ex", "mailto:a", "https://h.ex/d"]


def _equals_sql(spark, name):
    """The query on pages whose titles are cut within a reference equals its SQL."""
    import duckdb

    import __spark_entry__ as entry
    from tidewell.sources.scratch import scratch_path

    path = scratch_path(spark, "cut")
    cuts = ("&", "&a", "&am", "&amp", "&amp;", "&q", "&quo", "&quot", "&quot;", "&copy", "&middot", "&amp;quot", "&ampquot;", "&quotamp;", "&amp;&quot a")
    made = [(i, f"https://h.ex/{i}", f"<html lang=\"en\"><title>Token = {cut}</title><article><h1>Token = {cut}</h1><p>Token = {cut}<p>b &quot;c&quot; {cut}</p></article></html>") for i, cut in enumerate(cuts)]
    spark.createDataFrame(made, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.read.parquet("/root/testdata/sf0.001/orders.parquet").limit(0).write.parquet(f"{path}/orders.parquet")
    duck = duckdb.connect()
    for t in ("pages", "orders"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path.removeprefix('file:')}/{t}.parquet/*.parquet')")
    rows = entry.queries()[name](spark, path)
    want = duck.execute(f"SELECT {', '.join(rows.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert len(want) == len(cuts) and sorted(map(tuple, rows.collect()), key=repr) == sorted(want, key=repr)


def test_pairs_of_cut_references(spark):
    _equals_sql(spark, "extract_detail_pairs")


def test_fields_of_cut_references(spark):
    _equals_sql(spark, "extract_page_fields")
