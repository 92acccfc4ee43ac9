"""One-pass replacement against a plain scan, and leads of pages against an event parser."""

import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from weft.functions import html, matching, text
from weft.operators import grounding


def scan(t, find, put):
    out, i = "", 0
    while i < len(t):
        hits = [(len(f), -k) for k, f in enumerate(find) if f and t.startswith(f, i)]
        if hits:
            n, k = max(hits)
            out, i = out + put[-k], i + n
        else:
            out, i = out + t[i], i + 1
    return out


def test_automaton_equals_a_scan():
    r = random.Random(1)
    for _ in range(400):
        find = ["".join(r.choice("abc$") for _ in range(r.randrange(5))) for _ in range(r.randrange(7))]
        t = "".join(r.choice("abc$") for _ in range(r.randrange(40)))
        put = [f"<{i}>" for i in range(len(find))]
        assert matching.replaced(t, find, put) == scan(t, find, put)
    assert matching.replaced("", ["a"], ["b"]) == "" and matching.replaced("abc", [], []) == "abc"


def test_replacements_are_not_looked_at_again(spark):
    pair = lambda v, p: F.struct(F.lit(v).alias("val"), F.lit(p).alias("prop"))
    df = spark.createDataFrame([("Anna is also label",), (None,)], "x string")
    values = F.array(pair("label", "alias"), pair("Anna", "label"), pair("", "e"), pair(None, "n"), pair("Anna", "zeta"))
    got = [r[0] for r in df.select(grounding.tag(F.col("x"), values)).collect()]
    assert got == ["$label$ is also $alias$", None]
    back = F.array(pair("$alias$", "label"), pair("x", "alias"), pair("second", "label"))
    assert df.select(grounding.fill(F.lit("$label$ is $alias$, $5 for $other$"), back)).first()[0] == "$alias$ is x, $5 for $other$"
    assert df.select(grounding.fill(F.col("x"), F.lit(None).cast("array<struct<val:string,prop:string>>"))).first()[0] == "Anna is also label"


class Events(HTMLParser):
    """Paragraphs of the first article by the events of the standard library's parser; for pages whose only ends left out are those of p and li."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside = self.done = False
        self.parts = []
        self.p = None

    def handle_starttag(self, tag, attrs):
        if tag in html.ENDS_P:
            self.p = None
        if tag == "article" and not self.done:
            self.inside = True
        elif tag == "p" and self.inside:
            self.p = []
            self.parts.append(self.p)
        elif tag == "br" and self.p is not None:
            self.p.append(" ")

    def handle_endtag(self, tag):
        if tag == "p":
            self.p = None
        if tag == "article":
            self.inside, self.done, self.p = False, True, None

    def handle_data(self, data):
        if self.inside and self.p is not None:
            self.p.append(data)


def test_leads_equal_those_of_an_event_parser(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    for page in pages:
        events = Events()
        events.feed(page)
        want = re.sub(r"[ \n\r\t]+", " ", " ".join("".join(p) for p in events.parts)).strip(" ")
        assert html.lead(page, text.DROPPED) == want
    assert sum(len(html.lead(p, text.DROPPED)) for p in pages) > 100_000


@pytest.mark.parametrize("page,want", [
    ('<article><p>A <span class="IPA">x <span>y</span> z</span>B</p></article>', "A B"),
    ('<article><p>A <sup class="reference"><sup>1</sup><i>2</sup>B', "A B"),
    ('<article><p>A<table><tr><td>cell<td>two<p>in cell</table><p>B', "A in cell B"),
    ("<article><p>A <b>bold<p>B</b> c</article><article><p>no", "A bold B c"),
    ('<section><div><p>A</div>B<p title="a>b">C</section>D<p>E', "A C"),
    ('<article><p>1 &lt; 2 &amp;amp; <a href="./X_(y)">l <i>m</i></a> <a href=./Z>z</a> <a class="new" href="./N">n</a> <a href="/q">q</a>', "1 < 2 &amp; [l m](:X_(y)) [z](:Z) n q"),
    ('<p>before<section><p>A<!-- <p>no --><script>if (a < "<p>") {}</script>b<textarea><p>raw</textarea></p>', "Ab"),
    ("<article><ul><li>one<li><p>two<ul><li><p>three</ul>four</ul><p>five", "two three five"),
    ("<article><p class='Inline-Template'>gone</p><div class='IPA'><p>gone</p></div><p>A<br/>b < c <unclosed", "A b < c <unclosed"),
    ("no markup", ""), ("", ""), (None, None),
])
def test_nested_and_unclosed_elements(page, want):
    assert html.lead(page, text.DROPPED) == want
