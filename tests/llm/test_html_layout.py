import html as stdlib
import random
import re
from html.parser import HTMLParser

import pytest

from tsloom.llm import html_layout as H

CASES = {
    "": "",
    "plain  text\n here": "plain text here",
    "<p>one<p>two</p>three": "one\n\ntwo\n\nthree",
    "<div>a</div><div>b</div>c": "a\nb\nc",
    "a<b>b</b> <i>c</i>d": "ab cd",
    "x<br>y<br/>z": "x\ny\nz",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": "* a\n* b\n  * c\n* d",
    "<ol start=3><li>a</li><li value=7>b</li><li>c</li></ol>": "3. a\n7. b\n8. c",
    "<li><p>one</p><p>two</p></li>": "* one\n\n  two",
    "<table><tr><th>Name<th>N<tr><td>longer name<td>1</table>": "Name         N\nlonger name  1",
    "<table><td>a<td>b<tr><td colspan=2>wide wide wide wide<tr><td>c<td>d</table>": "a  b\nwide wide wide wide\nc  d",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c</table>": "a  b\n   c",
    "<table><caption>T</caption><tfoot><tr><td>f</tfoot><tr><td>x</table>": "T\n\nx\nf",
    "<table><tr><td><p>a</p><p>b</p></td><td>c</td></tr></table>": "a  c\n\nb",
    "<head><title>t</title></head><body>x<script>var a='</p>';</script><style>p{}</style>y": "xy",
    "a<!-- b --> c<!-- unclosed": "a c",
    "<p hidden>no</p><p style='display: none'>no</p><p aria-hidden=true>shown</p><p>yes": "shown\n\nyes",
    "<div style='visibility:hidden'>a<b style='visibility:visible'>b</b>c</div><i style='backface-visibility:hidden'>d</i>": "b\nd",
    "<details><summary>s</summary>body</details><details open><summary>t</summary>more</details>": "s\nt\nmore",
    "<select><option>one<option selected>two</select><svg><title>no</title><text>svg</text></svg> <math><mi>x</mi></math>": "one\ntwo\nsvg x",
    "<table><tr><td>a<caption>C</caption><tr><td>b</table>": "C\n\na\nb",
    "<table><tr><td>日本<td>x<tr><td>abcd<td>y<tr><td>e\u0301<td>z</table>": "日本  x\nabcd  y\ne\u0301     z",
    "<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d<tbody><tr><td>e<td>f</table>": "a  b\n   c\n   d\ne  f",
    "<ol reversed><li>a<li>b<li>c</ol><ol start=-1><li>m<li>n</ol>": "3. a\n2. b\n1. c\n\n-1. m\n0. n",
    "<pre>\n a\n  b</pre>c": " a\n  b\n\nc",
    "&lt;b&gt; &amp;&nbsp;&eacute; &#65; &copy;": "<b> &\xa0é A ©",
    "<img alt='pic'><input type=submit value=Go><input type=hidden value=x>": "picGo",
    "<blockquote>q<p>r</blockquote>s": "  q\n\n  r\n\ns",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n  d\nu\n  e",
    "1 < 2 and <3": "1 < 2 and <3",
    "</p>a</div>b</br>c": "ab\nc",
    "<p title='a>b'>x": "x",
    "<h1>T</h1>x<hr>y": "T\n\nx\n\ny",
    "<script>never closed": "",
    "<q>hi</q>": "“hi”",
    "a<p": "a",
}


@pytest.mark.parametrize("page", list(CASES))
def test_cases(page):
    assert H.extract(page).lstrip("\n") == CASES[page]


class Words(HTMLParser):
    """All words outside hidden elements, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("head", "script", "style", "title")

    def handle_endtag(self, tag):
        self.skip -= tag in ("head", "script", "style", "title")

    def handle_data(self, data):
        if not self.skip:
            self.words += data.split()


def test_no_word_is_lost_or_made_up(spark, sf):
    rows = {r.page_id: r.text for r in H.query(spark, sf).collect()}
    for page in spark.read.parquet(f"{sf}/pages.parquet").collect():
        p = Words()
        p.feed(page.html)
        strip = lambda words: sorted("".join(re.sub(r"^[*]$|^\d+[.]$", "", w) for w in words))
        assert strip(rows[page.page_id].split()) == strip(p.words), page.page_id


def test_edge_cases(spark):
    deep = "<div>" * 20000 + "deep" + "</div>" * 20000
    wide = "<p>" + "word " * 200000
    rows = [(1, None), (2, ""), (3, deep), (4, wide), (None, "<b>x</b>"), (None, "<b>x</b>"), (5, "<" * 5000), (6, "<table>" * 300 + "z"), (7, "<a b='" * 500)]
    df = spark.createDataFrame([(i, h, 1) for i, h in rows], "page_id long, html string, text int")
    got = [(r.page_id, r.text) for r in H.extract_texts(df).collect()]
    assert len(got) == len(rows)
    by = dict(got)
    assert by[1] == by[2] == "" and by[3] == "deep" and by[4].split() == ["word"] * 200000 and by[5] == "<" * 5000 and by[6].strip() == "z"
    assert H.extract_texts(df.limit(0)).count() == 0
    assert stdlib.unescape("&amp;") == "&"


def made(rng, depth=0, inside=""):
    """A random block: (html, rows), where a row is a line or None for an empty line wanted."""
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6)))
    kinds = ["p", "div", "h2", "text"] + (["ul", "ol", "quote", "table", "none"] if depth < 3 else [])
    kind = rng.choice(kinds)
    words = [word() for _ in range(rng.randint(1, 5))]
    if kind in ("p", "h2", "div", "text"):
        body = rng.choice([" ", "  ", "\n"]).join(f"<b>{w}</b>" if rng.random() < 0.2 else w for w in words)
        tag = "div" if kind == "text" else kind
        gap = [None] if kind in ("p", "h2") else []
        return f"<{tag}>{body}</{tag}>", [*gap, " ".join(words), *gap]
    if kind == "none":
        return f"<div style='color:red; display : none'>{words[0]}</div>", []
    if kind == "quote":
        page, rows = blocks(rng, depth + 1)
        return f"<blockquote>{page}</blockquote>", [None, *(r and "  " + r for r in rows), None]
    if kind == "table":
        cells = [[" ".join(word() for _ in range(rng.randint(1, 2))) for _ in range(3)] for _ in range(rng.randint(1, 4))]
        widths = [max(len(r[k]) for r in cells) for k in range(3)]
        page = "".join("<tr>" + "".join(f"<td>{c}" + rng.choice(["", "</td>"]) for c in r) + rng.choice(["", "</tr>"]) for r in cells)
        return f"<table>{page}</table>", [None, *("  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in cells), None]
    page, rows, number = "", [], rng.choice([1, 1, 9])
    for k in range(rng.randint(1, 4)):
        mark = f"{number + k}. " if kind == "ol" else "* "
        first = word()
        inner, more = made(rng, 3) if rng.random() < 0.3 else ("", [])
        page += f"<li>{first}{inner}" + rng.choice(["", "</li>"])
        rows += [mark + first, *(r and " " * len(mark) + r for r in more)]
    start = f" start={number}" if number > 1 else ""
    return f"<{kind}{start}>{page}</{kind}>", [None, *rows, None]


def blocks(rng, depth=0):
    parts = [made(rng, depth) for _ in range(rng.randint(1, 4))]
    return rng.choice(["", " ", "\n"]).join(p for p, _ in parts), [r for _, rows in parts for r in rows]


@pytest.mark.parametrize("seed", range(300))
def test_layout_of_random_pages(seed):
    """Against rows made along with the page."""
    page, rows = blocks(random.Random(seed))
    lines = []
    for r in rows:
        if r is not None:
            lines.append(r)
        elif lines and lines[-1] != "":
            lines.append("")
    assert H.extract(page) == "\n".join(lines).strip("\n"), page
