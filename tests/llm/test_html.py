"""Layout of pages: implied tags, visibility, blocks, lists, tables; odd markup never crashes."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from turnloom.llm.html_text import extract, parse, render, title


def text(source):
    return render(parse(source))


CASES = {
    "implied paragraphs": ("<p>One<p>Two <b>bold\n text</b>", "One\n\nTwo bold text"),
    "unclosed formatting": ("<p><b>Head.<br><p>Body", "Head.\n\nBody"),
    "no head or body tag": ("<title>T</title><meta charset=x>Hello<div>there", "Hello\nthere"),
    "text after the end": ("<html><body>a</body></html>b", "ab"),
    "white space": ("<div> a \n\t b<span> c</span> </div>", "a b c"),
    "no-break space stays": ("<p>a&nbsp; b", "a  b"),
    "entities": ("&lt;b&gt; &amp;amp; &eacute;&#x41;&copy", "<b> &amp; éA©"),
    "inline and block": ("a<i>b</i>c<div>d</div>e", "abc\nd\ne"),
    "headings stand apart": ("<h1>A</h1>b<h2>C</h2><p>d", "A\n\nb\n\nC\n\nd"),
    "line breaks": ("a<br>b<br><br>c", "a\nb\n\nc"),
    "list": ("<ul><li>a<li>b <b>c</b></ul>d", "- a\n- b c\n\nd"),
    "nested list": ("<ol start=9><li>a<ul><li>x<li>y</ul><li>b</ol>", "9. a\n   - x\n   - y\n10. b"),
    "item of several lines": ("<ul><li><p>a<p>b</ul>", "- a\n\n  b"),
    "definitions": ("<dl><dt>T<dd>D<dt>U<dd>E</dl>", "T\n  D\nU\n  E"),
    "quote": ("x<blockquote>a<br>b</blockquote>y", "x\n\n> a\n> b\n\ny"),
    "preformatted": ("<pre>a\n  b\tc\n</pre>d", "a\n  b\tc\n\nd"),
    "table": ("<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>", "a     bbb\ncccc  d"),
    "table of wide characters": ("<table><tr><td>漢字<td>x<tr><td>abc<td>y</table>", "漢字  x\nabc   y"),
    "cells without a row": ("<table><td>a<td>b</table>", "a  b"),
    "spanning cell": ("<table><tr><td colspan=2>wide cell<td>z<tr><td>a<td>b<td>c</table>", "wide cell  z\na  b       c"),
    "cell of several lines": ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
    "table in a table": ("<table><tr><td><table><tr><td>a<td>b</table><td>c</table>", "a  b  c"),
    "caption and sections": ("<table><caption>C</caption><thead><tr><th>h</thead><tbody><tr><td>d</table>", "C\n\nh\nd"),
    "hidden": ("a<div hidden>no</div><p style='display: none'>no</p><script>if (a<b) no</script><style>p{}</style><template>no</template>b", "ab"),
    "visibility": ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b>no</div>", "yes"),
    "style rules": ("<style>.x, #y {color:red; display:none} em{visibility:hidden}</style><p class='q x'>no<p id=y>no<em>no</em><p>yes", "yes"),
    "details": ("<details><summary>S</summary>no</details><details open><summary>T</summary>yes</details>", "S\nT\nyes"),
    "comments": ("a<!-- <p>no --><!DOCTYPE x><![CDATA[b<c]]>", "ab<c"),
    "script text holds tags": ("<script>var t='</p>';</script>a", "a"),
    "attributes with angle brackets": ("<a title='x > y' href=\"a>b\">c</a>", "c"),
    "rules for other media": ("<style>@media print { .article, nav {display:none} } @media (max-width: 9em) {p{display:none}}\n@supports (x:y) {@media screen {p{display:none}}} .z{display:none}</style><nav>a</nav><p class=article>b<p class=z>no", "a\n\nb"),
    "rules for screens": ("<style><!-- @import 'a;{'; @media print, only screen{.x{display:none}} @layer l {.y{display:none}} b{content:'}'; /* } */ i:hover{x:y} display:none} --></style>a<i class=x>no</i><u class=y>no</u><b>no</b><s>b</s>", "ab"),
    "rules cut off": ("<style>.x{display:none</style>a<b class=x>no</b>", "a"),
    "options": ("<p>Pick <select><optgroup label=G><option>one<option>two</optgroup><option label=three>no</select> now", "Pick\nG\none\ntwo\nthree\nnow"),
    "text area": ("a <textarea>\nx <b>\n  y</textarea>", "a x <b>\n  y"),
    "formula": ("a <math><semantics><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></semantics></math> b", "a x=1 b"),
    "drawing": ("a<svg><title>no</title><defs><text>no</text></defs> no <g><text>b <tspan>c</tspan></text><path d=x /></g><foreignObject><p>d</p></foreignObject></svg>e", "a\nb c\n\nd\n\ne"),
    "drawings left open": ("<svg/>a<svg><g><p>b</p><svg><path/></svg>c", "a\n\nb\n\nc"),
    "broken markup": ("</p></i>a < b <3 <", "a < b <3 <"),
    "cut off": ("<p>a<div class='x", "a"),
    "empty": ("", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_layout(name):
    source, want = CASES[name]
    assert text(source) == want


def test_title():
    assert title(parse("<head><title> A &amp;\n B </title>")) == "A & B" and title(parse("x")) is None


def test_deep_and_long_pages():
    assert text("<div>" * 50_000 + "x") == "x"
    assert text("<ul><li>" * 300 + "x").endswith("x")
    assert len(text("<p>word " * 50_000).split("\n\n")) == 50_000


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("<p> </p> <ul> <li> </ul> <table> <tr> <td> </td> </table> <b> </b> <div> </div> <dd> <blockquote> </blockquote> <pre> <caption> </tr> <select> <option> <br> a b".split()), max_size=30))
def test_any_nesting_keeps_visible_text(parts):
    got = text("".join(parts))
    if "<select>" not in parts:
        assert sorted(c for c in got if c in "ab") == sorted(c for p in parts if p in "ab" for c in p)


def test_extract(spark):
    rows = [(1, "u", "<title>t</title><p>a<p>b"), (2, None, None), (3, "u", ""), (1, "u", "<title>t</title><p>a<p>b"), (None, "u", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as title")
    got = sorted((r["page_id"] or 0, r["title"], r["text"], r["n_lines"]) for r in extract(pages).collect() if r["text"] is not None)
    assert got == [(0, None, "x", 1), (1, "t", "a\n\nb", 3), (1, "t", "a\n\nb", 3), (3, None, "", 0)]
    assert [r["n_lines"] for r in extract(pages.filter("page_id = 2")).collect()] == [None]
    assert extract(pages.limit(0)).count() == 0


def test_title_of_a_drawing_is_not_the_page_title():
    assert title(parse("<svg><title>no</title></svg><title>yes</title>")) == "yes"


def test_deep_html_in_a_drawing():
    assert text("<svg><foreignObject>" + "<div>" * 50_000 + "x") == "x"
