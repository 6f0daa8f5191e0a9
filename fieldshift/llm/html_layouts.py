"""Labelled pages for the block labeller: the corpus's own markup, and its texts laid out anew.

Pages whose markup names its parts (article, nav, footer, ...) are labelled by
it. As a corpus may know one template only, the same texts are also set in
random layouts with known parts: containers with and without telling names,
menus, headers, sidebars, notices, adverts and forms before, after and inside
the article, and reader comments behind it.
"""

from __future__ import annotations

import html
from random import Random

import numpy as np

from fieldshift.llm.html_blocks import Block

# Names of elements and class words by which markup tells its parts.
MAIN = frozenset("article main .main .article .articlebody .post .entry .content .story".split())
ASIDE = frozenset("nav footer aside form dialog menu button".split()) | frozenset(
    ".ad .ads .advert .advertisement .alert .banner .breadcrumb .breadcrumbs .comment .comments .cookie .copyright .disclaimer .footer .header .login "
    ".menu .modal .nav .navbar .navigation .newsletter .notice .popup .promo .related .replies .reply .search .share .sharing .sidebar .signup .social "
    ".sponsor .sponsored .subscribe .toolbar .widget".split()
)


def by_markup(page: list[Block]) -> np.ndarray | None:
    """1 for main text, 0 for the rest, by the innermost telling element; None if the markup names no main part."""
    found, told = [], False
    for b in page:
        label = None
        for at in range(len(b.path) - 1, -1, -1):
            names = set(b.path[at])
            if names & ASIDE or ("header" in names and not any(set(e) & MAIN for e in b.path[:at])):
                label = 0
            elif names & MAIN:
                label, told = 1, True
            if label is not None:
                break
        found.append(label or 0)
    return np.array(found, np.float32) if told else None


def unnamed(page: list[Block]) -> np.ndarray:
    """1 for blocks that stand in no element named as something else than main text."""
    return np.array([float(not any(set(e) & ASIDE or "header" in e for e in b.path)) for b in page], np.float32)


def _words(rng: Random, pool: list[str], low: int, high: int) -> str:
    words = rng.choice(pool).split() or ["x"]
    n, at = rng.randint(low, high), rng.randrange(len(words))
    return " ".join((words * (1 + (at + n) // len(words)))[at : at + n])


class _Layout:
    """One random page: fragments of markup, and the texts of its main part."""

    def __init__(self, rng: Random, title: str, paragraphs: list[str], pool: list[str]):
        self.rng, self.title, self.paragraphs, self.pool = rng, title, paragraphs, pool
        self.main: set[str] = set()

    def pick(self, *options):
        return self.rng.choice(options)

    def some(self, low: int, high: int) -> str:
        return html.escape(_words(self.rng, self.pool, low, high))

    def links(self, low: int = 3, high: int = 9) -> str:
        item = self.pick("<li><a href='#'>{}</a></li>", "<a href='#'>{}</a> ", "<div><a href='#'>{}</a></div>", "<p><a href='#'>{}</a></p>")
        items = "".join(item.format(self.some(1, 4)) for _ in range(self.rng.randint(low, high)))
        return f"<ul>{items}</ul>" if item.startswith("<li") else items

    def menu(self) -> str:
        tag, attrs = self.pick(("nav", ""), ("nav", " class='menu'"), ("div", " class='menu'"), ("div", " id='nav'"), ("ul", " class='breadcrumbs'"), ("div", ""))
        return f"<{tag}{attrs}>{self.links()}</{tag}>"

    def header(self) -> str:
        tag, attrs = self.pick(("header", ""), ("header", " class='site-header'"), ("div", " id='header'"), ("div", " class='top banner'"))
        name = f"<{self.pick('h1', 'div', 'p', 'a')}>{self.some(1, 4)}</>"
        return f"<{tag}{attrs}>{name}<p>{self.some(2, 9)}</p>{self.links() if self.rng.random() < 0.5 else ''}</{tag}>"

    def footer(self) -> str:
        tag, attrs = self.pick(("footer", ""), ("footer", " class='site-footer'"), ("div", " id='footer'"), ("div", " class='footer bottom'"), ("div", ""))
        line = self.pick("&copy; {} &middot; {}", "Copyright 2024 {}. {}", "{} | All rights reserved. {}")
        inner = line.format(self.some(1, 2), self.some(3, 14))
        return f"<{tag}{attrs}>{self.pick('<p>{}</p>', '{}', '<small>{}</small>').format(inner)}{self.links() if self.rng.random() < 0.4 else ''}</{tag}>"

    def sidebar(self) -> str:
        tag, attrs = self.pick(("aside", ""), ("aside", " class='sidebar'"), ("div", " class='sidebar'"), ("div", " id='sidebar'"), ("section", " class='related'"))
        body = self.links() if self.rng.random() < 0.6 else "".join(f"<p>{self.some(4, 40)}</p>" for _ in range(self.rng.randint(1, 3)))
        return f"<{tag}{attrs}><{(h := self.pick('h2', 'h3', 'h4'))}>{self.pick('Related', 'Popular', self.some(1, 3))}</{h}>{body}</{tag}>"

    def notice(self) -> str:
        tag, attrs = self.pick(
            ("div", " class='cookie-notice'"), ("div", " role='alert'"), ("div", " class='notice'"), ("dialog", ""), ("section", " class='banner'"), ("div", " id='cookie-banner'"), ("p", " class='notice'"),
        )
        text = self.pick("We use cookies. {}", "{} Accept all", "Please note: {}", "{}")
        return f"<{tag}{attrs}>{text.format(self.some(4, 30))}</{tag}>"

    def advert(self) -> str:
        tag, attrs = self.pick(
            ("div", " class='ad'"), ("div", " class='ads'"), ("div", " class='advert'"), ("aside", " class='ad'"), ("div", " class='sponsored'"), ("section", " class='promo'"), ("div", " id='ad-1'"), ("p", " class='ad'"), ("ins", " class='adsbygoogle ad'"),
        )
        if tag == "ins":
            return f"<div{attrs}><ins>{self.some(3, 20)}</ins></div>"
        return f"<{tag}{attrs}>{self.pick('Advertisement {}', 'Sponsored: {}', '{}', '{}').format(self.some(3, 40))}</{tag}>"

    def form(self) -> str:
        fields = "".join(self.pick("<label>{}</label><input name='x'>", "<p>{} <input></p>", "<div>{}<textarea></textarea></div>").format(self.some(1, 5)) for _ in range(self.rng.randint(1, 3)))
        attrs = self.pick("", " class='newsletter'", " class='search'", " id='login'")
        return f"<form{attrs}>{self.pick('', '<p>' + self.some(4, 20) + '</p>')}{fields}<button>{self.pick('Send', 'Subscribe', self.some(1, 2))}</button></form>"

    def comments(self) -> str:
        tag, attrs = self.pick(("section", " class='comments'"), ("div", " id='comments'"), ("div", " class='comments'"), ("section", " id='comments'"), ("div", " class='reader-comments'"))
        one = self.pick("<div class='comment'><b>{a}</b><p>{t}</p></div>", "<li class='comment'><p>{a}</p><p>{t}</p></li>", "<article class='comment'><p>{t}</p></article>", "<p>{a}: {t}</p>", "<div><h4>{a}</h4>{t}</div>")
        items = "".join(one.format(a=self.some(1, 2), t=self.some(3, 60)) for _ in range(self.rng.randint(1, 6)))
        return f"<{tag}{attrs}><h3>{self.pick('Comments', '3 comments', self.some(1, 2))}</h3>{items}</{tag}>"

    def kept(self, tag: str, text: str) -> str:
        self.main.add(" ".join(text.split()))
        return f"<{tag}>{html.escape(text)}</{tag}>"

    def article(self) -> str:
        rng = self.rng
        parts = [self.kept("h1", self.title)] if self.title and rng.random() < 0.8 else []
        tag = self.pick("p", "p", "p", "p", "div")
        for text in self.paragraphs:
            if rng.random() < 0.08:
                parts.append(self.kept(self.pick("h2", "h3"), _words(rng, self.pool, 1, 6)))
            if rng.random() < 0.06:
                items = "".join(self.kept("li", _words(rng, self.pool, 2, 15)) for _ in range(rng.randint(2, 5)))
                parts.append(f"<{(kind := self.pick('ul', 'ol'))}>{items}</{kind}>")
            if rng.random() < 0.05:
                parts.append(f"<blockquote>{self.kept('p', _words(rng, self.pool, 5, 30))}</blockquote>")
            if rng.random() < 0.04:
                cells = "".join(self.kept("td", _words(rng, self.pool, 1, 3)) for _ in range(4))
                parts.append(f"<table><tr>{cells}</tr></table>")
            parts.append(self.kept(tag, text))
        for make in (self.advert, self.sidebar, self.form, self.notice):
            if rng.random() < 0.15:
                parts.insert(rng.randint(0, len(parts)), make())
        if rng.random() < 0.2:
            parts.append(self.comments())
        tag, attrs = self.pick(
            ("article", ""), ("article", ""), ("main", ""), ("article", " class='post'"), ("div", " class='content'"), ("div", " id='content'"), ("div", " class='entry-content'"), ("section", " class='article-body'"), ("div", " role='main'"), ("div", " class='story'"), ("div", ""), ("section", ""),
        )
        inner = f"<{tag}{attrs}>{''.join(parts)}</{tag}>"
        return self.pick("{}", "{}", "{}", "<main>{}</main>", "<div class='wrap'>{}</div>", "<div><div>{}</div></div>").format(inner)

    def page(self) -> str:
        rng = self.rng
        before = [make() for make, share in ((self.notice, 0.3), (self.header, 0.5), (self.menu, 0.8), (self.advert, 0.5), (self.sidebar, 0.3), (self.form, 0.15)) if rng.random() < share]
        after = [make() for make, share in ((self.comments, 0.4), (self.advert, 0.3), (self.sidebar, 0.3), (self.form, 0.25), (self.notice, 0.15), (self.footer, 0.85)) if rng.random() < share]
        body = self.article()
        if rng.random() < 0.3:
            body = f"<div class='page'>{body}</div>"
        return f"<html><head><title>{html.escape(self.title)}</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>"


def laid_out(rng: Random, page: list[Block], labels: np.ndarray, pool: list[str]) -> tuple[str, set[str]]:
    """A page's main texts in a random layout, and the texts that belong to its main part."""
    texts = [b.text for b, label in zip(page, labels) if label]
    title = texts[0] if len(texts[0]) < 200 else ""
    held = _Layout(rng, title, texts[1:] if title else texts, pool)
    return held.page(), held.main
