"""Pages written by hand, of shapes that the training pages' maker does not write, each with what must stay and what must go."""

import pytest

from strata.llm.html_crf import describe, leaf_blocks, main_text, trained_field

SENTENCES = (
    "The council met again on Tuesday to talk about the bridge that was closed last winter after the storm had damaged it.",
    "Nobody in the village could say when the ferry would run again, and the school bus now takes an hour longer each way.",
    "Engineers found cracks in two of the four pillars; they want to replace both before any lorry may cross.",
    "„Wir haben lange genug gewartet“, sagte die Bürgermeisterin am Abend vor den Leuten, die gekommen waren.",
    "Les travaux doivent commencer au printemps, si le conseil vote le budget et si la rivière le permet.",
    "A second report, which is due in May, will say what a new bridge would cost and who has to pay for it.",
)


def text(i):
    return f"{SENTENCES[i % len(SENTENCES)]} That was part {i}."


def paragraphs(n, tag="p"):
    return "".join(f"<{tag}>{text(i)}</{tag.split()[0]}>" for i in range(n))


MENU = "<ul>" + "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in ("Home", "News", "Sport", "Weather", "Contact")) + "</ul>"
HEAD = "<h1>The bridge stays closed</h1>"
SHAPES = {
    "bare body": lambda n: HEAD + paragraphs(n),
    "bare body with a menu": lambda n: f"<nav>{MENU}</nav>{HEAD}{paragraphs(n)}<footer><p>© 2020 The Village Times</p></footer>",
    "a foreign name": lambda n: f"<div class='inhalt'>{HEAD}{paragraphs(n)}</div>",
    "foreign names all over": lambda n: f"<div id='seite'><div class='kopf menu'>{MENU}</div><div class='inhalt'>{HEAD}{paragraphs(n, 'div class=absatz')}</div></div>",
    "div paragraphs in an article": lambda n: f"<article>{HEAD}{paragraphs(n, 'div')}</article>",
    "divs only": lambda n: f"<div><div>{HEAD}</div><div>{paragraphs(n, 'div')}</div></div>",
    "a layout table": lambda n: f"<table><tr><td class='nav'>{MENU}</td><td>{HEAD}{paragraphs(n)}</td></tr></table>",
    "a table without names": lambda n: f"<table><tr><td>{HEAD}{paragraphs(n)}</td></tr></table>",
    "centred": lambda n: f"<center>{HEAD}{paragraphs(n)}</center>",
    "hashed names": lambda n: f"<div class='css-1x2y'><div class='sc-ab12'>{HEAD}</div>{paragraphs(n, 'p class=css-9z')}</div>",
    "a section by section": lambda n: HEAD + "".join(f"<section><p>{text(i)}</p></section>" for i in range(n)),
    "open paragraphs": lambda n: HEAD + "".join(f"<p>{text(i)}" for i in range(n)),
}


def kept(page):
    return main_text(f"<html><head><title>x</title></head><body>{page}</body></html>", trained_field()).split("\n\n")


@pytest.mark.parametrize("n", [1, 3, 8, 20])
@pytest.mark.parametrize("shape", SHAPES)
def test_articles_of_any_shape_and_length_stay(shape, n):
    assert kept(SHAPES[shape](n)) == ["The bridge stays closed", *map(text, range(n))]


JUNK = {
    "an advert": f"<div class='promo'><p>{text(3)}</p></div>",
    "a sponsor": f"<div class='box sponsored'>{text(2)}</div>",
    "comments": f"<div id='comments'><h3>Two comments</h3><p>{text(1)}</p><p>{text(5)}</p></div>",
    "replies": f"<section class='commentlist'><div class='comment'><b>Ann</b><p>{text(4)}</p></div></section>",
    "a sidebar": f"<aside><h3>Read more</h3>{MENU}</aside>",
    "related links": f"<div class='related'><h4>Related</h4>{MENU}</div>",
    "a newsletter": "<form class='newsletter'><p>Get our news by mail every morning.</p><input><button>Sign up</button></form>",
    "share buttons": "<div class='share'><a href='/f'>Share</a> <a href='/t'>Tell</a></div>",
    "a cookie notice": f"<div class='cookie-banner'><p>{text(0)}</p><button>Accept</button></div>",
    "a script": f"<script>document.write('<p>{text(2)}</p>')</script>",
}


@pytest.mark.parametrize("shape", ["article>p", "article>div", "div.post>p", "div.inhalt>p"])
@pytest.mark.parametrize("junk", JUNK)
def test_what_is_no_text_goes_wherever_it_stands(shape, junk):
    holder, tag = shape.split(">")
    name, _, css = holder.partition(".")
    opened = f"<{name} class='{css}'>" if css else f"<{name}>"
    page = f"<nav>{MENU}</nav>{opened}{HEAD}{paragraphs(3, tag)}{JUNK[junk]}<{tag}>{text(9)}</{tag}></{name}>{JUNK[junk]}"
    assert kept(page) == ["The bridge stays closed", *map(text, range(3)), text(9)]


def test_pages_without_an_article():
    for page in (MENU, f"<nav>{MENU}</nav><footer>© 2020</footer>", "", "<script>x</script>"):
        assert main_text(f"<body>{page}</body>", trained_field()) == ""


def test_features_tell_the_nearest_names_apart():
    blocks = leaf_blocks("<body><div class='post'><div class='promo'><p>one</p></div><p>two</p></div></body>")
    one, two = describe(blocks)
    assert "last=promo" in one and "name=post" in one and "junk=promo" in one and "within junk" in one
    assert "last=post" in two and "clean" in two
