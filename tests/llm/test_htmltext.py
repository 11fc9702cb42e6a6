"""Pages of other layouts than the trainer's: names that mislead, and what may not leak."""

from __future__ import annotations

import random

import pytest

from tidewire.llm.htmltext import SIGNS, default_model, name_signs

PAGE = "<html><body{}><nav><ul><li><a href=/>Home</a></li><li><a href=/b>News</a></li></ul></nav>{}<footer>&copy; 2024 All rights reserved</footer></body></html>"
ONE = "The council met on Monday to talk about the new bridge over the river. " * 3
TWO = "Work on it is to begin next spring, and the old one stays open until then. " * 3
PROSE = f"<p>{ONE}</p><p>{TWO}</p>"
TEXT = f"{ONE.strip()}\n{TWO.strip()}"
MISLEADING = [
    "performance", "information", "platform", "research-stock", "football", "inside", "responsive", "navigable", "no-comments-yet col-md-8", "modal-open header-image", "responsive-content",
    "text-center", "toolbox-free", "has-sidebar", "without-nav", "AdobeReader", "headline-news", "transform", "considered", "legalize", "printable-view-off",
]


@pytest.mark.parametrize("name", MISLEADING)
def test_a_name_that_only_holds_a_sign_loses_nothing(name):
    assert default_model().extract(PAGE.format("", f'<div class="{name}">{PROSE}</div>')) == TEXT
    assert default_model().extract(PAGE.format("", f'<div id="{name}"><section class="{name}">{PROSE}</section></div>')) == TEXT


def test_names_of_the_page_itself():
    body = ' class="home page header-fixed comment-open no-sidebar nav menu ad" id="footer"'
    assert default_model().extract(PAGE.format(body, f"<div>{PROSE}</div>")) == TEXT


def test_utility_classes_change_nothing():
    rng = random.Random(3)
    kinds = ["mt-{}", "px-{}", "col-lg-{}", "d-flex", "w-{}", "text-sm", "bg-gray-{}", "lg:grid-cols-{}", "justify-between", "clearfix", "u-{}", "elementor-{}", "css-{}x", "is-open", "leading-{}", "rounded", "shadow-{}", "flex-wrap", "gap-{}", "h-full"]
    utility = [rng.choice(kinds).format(rng.randint(0, 99)) for _ in range(200)]
    assert not any(name_signs(u) - {"main"} for u in utility)
    for k in range(0, 200, 10):
        names = " ".join(utility[k : k + 10])
        for inner, want in ((f"<div>{PROSE}</div>", TEXT), (f'<div><p class="lead">{ONE}</p><div>{TWO}</div></div>', TEXT)):
            assert default_model().extract(PAGE.format(f' class="{names}"', f'<div class="{names}"><div class="{names}">{inner}</div></div>')) == want


@pytest.mark.parametrize("extra", [
    f"<details><summary>Comments</summary><p>{ONE}</p><p>me too!</p></details>",
    f"<details><summary>12 comments</summary><div><p>{ONE}</p></div></details>",
    '<p class="sub-cta">Sign up for our newsletter today.</p>',
    '<table class="paid-partnership"><tr><td>Paid partnership</td><td>Buy now</td></tr></table>',
    f'<div class="comments"><h3>Comments</h3><p>{ONE}</p><p>{TWO}</p><p>{ONE}</p></div>',
    f'<div id="cookieNotice"><p>{ONE}</p><button>Agree</button></div>',
    '<div class="site-footer"><p>All rights reserved by the paper.</p></div>',
    '<div class="relatedPosts"><a href="/1">One more story</a> <a href="/2">Another story</a></div>',
])
def test_what_is_not_the_article_stays_out(extra):
    assert default_model().extract(PAGE.format("", f"<article>{PROSE}</article>{extra}")) == TEXT


def test_other_layouts():
    old = f'<html><body><table><tr><td class="menu"><a href="/">Home</a><br><a href="/x">Sport</a></td><td><h2>Bridge to be built</h2>{PROSE}</td></tr></table></body></html>'
    assert default_model().extract(old) == f"Bridge to be built\n{TEXT}"
    plain = f"<html><body><h1>Bridge to be built</h1>{PROSE}</body></html>"
    assert default_model().extract(plain) == f"Bridge to be built\n{TEXT}"
    deep = "<div>" * 40 + PROSE + "</div>" * 40
    assert default_model().extract(PAGE.format("", deep)) == TEXT


def test_signs_of_names():
    assert name_signs("site-footer") == {"edge"} and name_signs("adBox-2") == {"advert"} and name_signs("cookie_notice") == {"notice"} and name_signs("sign-up") == {"form"}
    assert name_signs("nav-main") == {"menu"} and name_signs("main") == {"main"} and name_signs("article-header") == {"edge", "main"} and name_signs("COMMENTS-LIST") == {"talk"}
    assert not name_signs("") and not name_signs("header-image") and not name_signs("modal-open") and not name_signs("Überschrift") and all(name_signs(w) == SIGNS[w] for w in SIGNS)
