"""Main text of pages without an article element, with layout classes, comments and deep nesting."""

import time

import pytest

from quern.llm.htmltext import main_text

P = ["This is a long paragraph, with several commas, and enough words in it to count as prose.", "Another one follows, no shorter than the first, so that the block is plainly the article's."]
BODY = "".join(f"<p>{p}</p>" for p in P)
WANT = " ".join(P)
NOISE = "<div class='{}'><p>Something else, beside the article, of some length, that nobody asked for.</p></div>"


@pytest.mark.parametrize("name", ["no-sidebar", "has-sidebar", "content with-sidebar", "post tag-x tags", "post-content comments-open", "menu-page", "cookie-recipe", "", "x"])
def test_layout_classes_keep_the_article(name):
    page = f"<html><body><div class='side'><p>Short, side block.</p></div><div class='{name}'>{BODY}</div></body></html>"
    assert main_text(page) == WANT


@pytest.mark.parametrize("name", ["sidebar", "comments", "widget widget_text", "cookie-notice", "related posts", "ad", "newsletter signup", "comment-body"])
def test_noise_by_class_goes(name):
    assert main_text(f"<body><nav><a href='/'>Home</a></nav><div class='main'>{BODY}</div>{NOISE.format(name)}</body>") == WANT
    assert main_text(f"<body><div class='wrap has-sidebar'><div class='post'>{BODY}{NOISE.format(name)}</div>{NOISE.format(name)}</div></body>") == WANT


def test_more_comments_than_article():
    page = f"<body><div class='post'>{BODY}</div><div id='comments'>{'<div class=comment><p>I liked this very much, thanks, and so did my aunt.</p></div>' * 30}</div></body>"
    assert main_text(page) == WANT
    page = f"<body><article>{BODY}</article><section id='comments'>{'<article class=comment><p>I liked this, thanks.</p></article>' * 9}</section></body>"
    assert main_text(page) == WANT


def test_headings_and_short_sections_stay():
    long = "".join(f"<p>{P[0]} {i}</p>" for i in range(12))
    page = f"<body><article><h1>Title</h1><div class='body'>{long}</div></article></body>"
    assert main_text(page).startswith("Title ")
    page = f"<body><div><section class='part'>{long}</section><section class='part'><p>Short end.</p></section></div></body>"
    assert main_text(page).endswith("Short end.")


def test_empty_vector_graphic_swallows_nothing():
    assert main_text(f"<body><svg width='1' /><div class='post'>{BODY}</div></body>") == WANT
    assert main_text(f"<body><svg width='1'><text>no</text></svg><div class='post'>{BODY}</div></body>") == WANT


def test_deep_nesting_takes_time_in_proportion():
    took = []
    for n in (4000, 16000):
        began = time.process_time()
        text = main_text("<div>some text, here </section></span>" * n)
        took.append(time.process_time() - began)
        assert text.count("some text") == n
    assert took[1] < 10 * took[0] + 0.5
