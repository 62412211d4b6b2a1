"""Main text as Markdown: links in place, tables of data, loose text, and what is found when little is."""

import time

import pytest

from strata.functions.html import read_page

PROSE = "This sentence has quite enough words in it to read like prose does on pages."


def md(html, url="http://h.example/dir/page"):
    return read_page(html, url)["markdown"]


def test_links_stay_in_place_and_are_whole():
    got = md('<body><p>For more on the matter see <a href="../x">the <b>other</b> page</a>, <a href="#here">here</a>, <a href="javascript:go()">this</a> and <a href="http://o.example/a b(c)">that [one]</a>.</p></body>')
    assert got == "For more on the matter see [the other page](http://h.example/x), here, this and [that (one)](http://o.example/a%20b%28c%29)."
    assert md('<p>Long text <a href="b">c</a></p>', None) == "Long text [c](b)"
    assert md('<p><a href="http://[bad">c</a> and more words here</p>') == "c and more words here"


def test_tables_with_spans_become_tables():
    page = "<body><table><tr><th rowspan=2>Name</th><th colspan=2>Size</th></tr><tr><th>in</th><th>cm</th></tr><tr><td><a href=/p>Pipe</a></td><td>1|2</td><td>3</td></tr><tr><td>Tap</table><p>After.</p></body>"
    assert md(page) == "| Name | Size |  |\n| --- | --- | --- |\n|  | in | cm |\n| [Pipe](http://h.example/p) | 1\\|2 | 3 |\n| Tap |  |  |\n\nAfter."


@pytest.mark.parametrize("span", ["0", "-3", "x", "", "99999999", "²", "1000"])
def test_odd_spans_are_borne(span):
    got = md(f"<table><tr><td rowspan='{span}' colspan='{span}'>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>")
    assert all(x in got for x in "abcd") and len(got) < 20_000


def test_layout_tables_are_read_as_blocks():
    inner = "<table><tr><td>k</td><td>v</td></tr><tr><td>l</td><td>w</td></tr></table>"
    got = md(f"<body><table><tr><td><a href=/1>Home</a> <a href=/2>News</a></td><td><h1>Head</h1><p>{PROSE}</p>{inner}</td></tr><tr><td>x</td><td>y</td></tr></table></body>")
    assert got.startswith(f"# Head\n\n{PROSE}\n\n| k | v |\n| --- | --- |\n| l | w |") and "Home" not in got


def test_loose_text_stays_by_itself_or_beside_prose():
    got = md(f"<body><div>{PROSE}<br>More of it<div>Two words</div>{PROSE}</div><div>Far off</div><div><a href=/a>one</a> <a href=/b>two</a></div><div>Buy now</div></body>")
    assert got == f"{PROSE} More of it\n\nTwo words\n\n{PROSE}\n\nFar off"


def test_little_text_is_looked_for_again():
    assert md("<body><nav>Menu here</nav><div>Few words</div><span>and some</span><footer>Legal</footer></body>") == "Few words\n\nand some"
    assert md("<body><div>Few words</div><p>" + PROSE * 3 + "</p><aside>no</aside></body>").endswith(PROSE)
    assert md("<body><nav>Only menu</nav></body>") == "" and md("") == "" and md(None) == ""


def test_what_is_named_otherwise_is_not_text():
    got = md(f'<body class="sidebar ad"><div class="ad">{PROSE} Buy.</div><div id="cookie-note">{PROSE} Accept.</div><article class="menu"><p class="lead">{PROSE}</p><div class="load">{PROSE} Kept.</div></article><section class="site related"><p>{PROSE} Other.</p></section></body>')
    assert got == f"{PROSE}\n\n{PROSE} Kept."


def test_items_quotes_and_headings():
    got = md("<body><h2>List</h2><ul><li>One<ul><li>Inner</li></ul></li><li><p>Two</p><p>more</p></li></ul><blockquote><p>Said</p></blockquote><pre>code here</pre></body>")
    assert got == "## List\n\n- One\n\n  - Inner\n\n- Two more\n\n> Said\n\ncode here"


def test_large_pages_are_written_in_time_that_grows_as_they_do():
    for page in ("<table>" + "<tr><td>a</td><td rowspan=1000 colspan=1000>b</td></tr>" * 300 + "</table>", "<table><tr><td>" * 3000, "<p>a <a href=x>b</a></p>" * 50_000, "<div>x <b>y</b>" * 20_000):
        start = time.monotonic()
        read_page(page, "http://h/")
        assert time.monotonic() - start < 20
