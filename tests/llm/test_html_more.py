"""Malformed attributes, names that only resemble notices, and what a host's wrapper finds inside articles."""

import random

import pytest

from tests.llm.test_ops import words
from volumetra.llm import html


@pytest.mark.parametrize(
    "page,text",
    [
        ("<p title=it's>Hello world</p>", "Hello world"),
        ("<article><p title=it's>One</p><p>it's two</p></article>", "One\n\nit's two"),
        ("<p data-x='a>b' title=\"c>d\">Hello</p>", "Hello"),
        ("<p \"stray>Hello</p>", "Hello"),
        ("<p title='never closed>Hello</p>", "Hello"),
        ("<p a=b'c\"d>Hello</p><p>more</p>", "Hello\n\nmore"),
        ("<p title = 'x > y'>Hello</p>", "Hello"),
    ],
)
def test_malformed_attributes(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize("name", ["banner-history", "promo-code", "cookie-recipe", "notice-period", "menu-of-the-day", "adscape"])
def test_names_of_content_stay(name):
    assert html.main_text(f"<article><p>x</p><div class='{name}'>kept</div></article>") == "x\n\nkept"


@pytest.mark.parametrize("name", ["ad", "ad-slot", "cookie-banner", "user comments", "comments-section", "newsletter-signup", "main-menu", "advert box", "inline-ad", "promo", "sponsored_block"])
def test_names_of_notices_go(name):
    assert html.main_text(f"<article><p>x</p><div class='{name}'>gone</div></article>") == "x"


def host(n, article):
    return [(i, f"http://a.example/{i}", f"<body><nav>menu</nav><article>{article(i)}</article></body>") for i in range(n)]


def extracted(spark, rows):
    out = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    return {r["page_id"]: r["text"] for r in out}


def test_template_inside_articles_goes(spark):
    text = [words(60, i) for i in range(12)]
    out = extracted(spark, host(12, lambda i: f"<h1>t{i}</h1><p>{text[i]}</p><div class='share'>Share on X</div><div class='more'>Read more stories</div>"))
    assert out == {i: f"t{i}\n\n{text[i]}" for i in range(12)}


def test_copies_of_an_article_have_no_template(spark):
    """Pages that differ in a detail only keep their article, and so do short pages and single ones."""
    same = words(60, 1)
    assert extracted(spark, host(8, lambda i: f"<h1>Title</h1><p>{same}</p><p>{i}</p>")) == {i: f"Title\n\n{same}\n\n{i}" for i in range(8)}
    assert extracted(spark, host(2, lambda i: f"<h1>Same</h1><p>{words(60, i)}</p>")) == {i: f"Same\n\n{words(60, i)}" for i in range(2)}
    rng = random.Random(0)
    texts = [words(50, rng.random()) for _ in range(10)]
    part = extracted(spark, host(10, lambda i: f"<h1>{'Column' if i % 2 else i}</h1><p>{texts[i]}</p>"))
    assert part == {i: f"{'Column' if i % 2 else i}\n\n{texts[i]}" for i in range(10)}
