"""Main text of built pages whose text is known: the expected text is kept while the page is written, no parser is used."""

import random

import pytest

from convlake.llm import html_text

WORDS = "stone river walked under clear light while seven birds crossed above old bridges towards evening market".split()


def sentence(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n)).capitalize() + "."


def links(rnd, n):
    return "".join(f'<li><a href="/{i}">{rnd.choice(WORDS)}</a></li>' for i in range(n))


JUNK = [lambda r: f"<nav><ul>{links(r, 8)}</ul></nav>",
        lambda r: f'<div class="ad-slot"><p>{sentence(r, 30)}</p></div>',
        lambda r: f'<div id="cookie-notice"><p>{sentence(r, 40)}</p><button>Accept</button></div>',
        lambda r: f'<aside><h2>More</h2><p>{sentence(r, 20)}</p></aside>',
        lambda r: f'<section id="comments"><h2>Replies</h2><p>{sentence(r, 60)}</p></section>',
        lambda r: f'<section id="discussion"><article><p>{sentence(r, 60)}</p></article></section>',
        lambda r: f"<form><label>{sentence(r, 9)}</label><input></form><script>var a = '<p>{sentence(r, 9)}</p>'</script>",
        lambda r: f'<div class="related-links"><ul>{links(r, 5)}</ul></div>']


def page(rnd, kind):
    paragraphs = [sentence(rnd, rnd.choice((3, 12, 40, 90))) for _ in range(rnd.randint(3, 9))]
    paragraphs[rnd.randrange(3)] = sentence(rnd, 80)
    body, title = "".join(f"<p>{p}</p>\n" for p in paragraphs), sentence(rnd, 4)
    text = [title, *paragraphs]
    inner = f"<h1>{title}</h1>{body}"
    if kind == "article":
        core = f"<article>{inner}</article>"
    elif kind == "main":
        core = f"<main><header><p>The <a href=/>Site</a> daily</p></header><article>{inner}</article></main>"
    elif kind == "nested":
        core = f'<article>{inner}<div><article><p>{sentence(rnd, 50)}</p></article></div></article>'
    elif kind == "teasers":
        core = f"<article>{inner}</article>" + "".join(f"<article><h3><a href=/{i}>{sentence(rnd, 6)}</a></h3></article>" for i in range(4))
    elif kind == "names":
        more = [sentence(rnd, 30), sentence(rnd, 35)]
        core = f'<article>{inner}<p class="share-price">{more[0]}</p><div id="search-results"><p>{more[1]}</p></div></article>'
        text += more
    elif kind == "empty article":
        core = f'<article><a href="/x">Go</a></article><div class="content">{inner}</div>'
    else:
        core = f'<div class="content">{inner}</div>'
    junk = [rnd.choice(JUNK)(rnd) for _ in range(4)]
    return f"<html><head><title>{title}</title></head><body>{junk[0]}{junk[1]}{core}{junk[2]}{junk[3]}</body></html>", "\n\n".join(text)


@pytest.mark.parametrize("kind", ["article", "main", "nested", "teasers", "names", "empty article", "none"])
def test_built_pages(kind):
    rnd = random.Random(kind)
    for _ in range(60):
        html, text = page(rnd, kind)
        assert html_text.main_text(html) == text


def test_names():
    assert [html_text.marked(v) for v in ("ad", "share-price", "shareButtons", "post-comments", "notice period", "load", "")] == [2, 1, 2, 2, 2, 0, 0]


def test_links_alone():
    assert html_text.main_text("<article><p><a href=x>only a link</a></p></article>") == "only a link"
    assert html_text.main_text("<p><a href=x>only a link</a></p>") == ""
