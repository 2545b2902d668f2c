"""Labelled pages that the extraction model learns from.

They are put together from kinds of blocks as pages of the web use them: ``data-content`` marks a block as
main text (1) or not (0) and holds for what is inside it. Words are made up; layout, names, order, lengths
and which blocks occur are drawn with a fixed seed.
"""

from __future__ import annotations

import random

# Usual names of the parts of a page.
ARTICLE = [
    ("article", ""), ("article", 'class="post"'), ("main", ""), ("main", 'id="content"'), ("div", 'class="content"'),
    ("div", 'id="main-content"'), ("div", 'class="article-body"'), ("div", 'class="entry-content"'),
    ("section", 'class="story"'), ("div", 'class="post-content"'), ("div", 'itemprop="articleBody"'), ("div", 'id="text"'),
]
MENU = [("nav", ""), ("nav", 'class="menu"'), ("div", 'class="navbar"'), ("div", 'id="nav"'), ("ul", 'class="menu"'),
        ("div", 'class="breadcrumbs"'), ("div", 'role="navigation"'), ("div", 'class="toc"'), ("div", 'class="pagination"')]
HEADER = [("header", ""), ("header", 'class="site-header"'), ("div", 'id="header"'), ("div", 'class="masthead"'),
          ("div", 'class="topbar"'), ("div", 'role="banner"')]
FOOTER = [("footer", ""), ("footer", 'class="site-footer"'), ("div", 'id="footer"'), ("div", 'class="copyright"'),
          ("div", 'role="contentinfo"'), ("div", 'class="legal"')]
SIDE = [("aside", ""), ("aside", 'class="sidebar"'), ("div", 'id="sidebar"'), ("div", 'class="widget"'),
        ("div", 'class="related"'), ("div", 'class="recommended"'), ("div", 'role="complementary"'), ("div", 'class="trending"')]
ADVERT = [("div", 'class="ad"'), ("div", 'class="ads"'), ("div", 'class="advert"'), ("div", 'class="advertisement"'),
          ("div", 'class="sponsored"'), ("div", 'id="ad-banner"'), ("div", 'class="promo"'), ("section", 'class="banner"')]
NOTICE = [("div", 'class="cookie-notice"'), ("div", 'id="cookie-banner"'), ("div", 'class="notice"'), ("div", 'role="alert"'),
          ("div", 'class="consent"'), ("div", 'class="popup"'), ("div", 'class="modal"'), ("div", 'role="dialog"'),
          ("div", 'class="alert"'), ("div", 'class="disclaimer"'), ("p", 'class="notice"')]
COMMENTS = [("section", 'id="comments"'), ("div", 'class="comments"'), ("div", 'class="comment-list"'),
            ("ol", 'class="commentlist"'), ("div", 'id="disqus-thread"'), ("section", 'class="responses"'),
            ("div", 'class="user-comments"'), ("div", 'class="replies"')]
FORM = [("form", ""), ("form", 'class="search"'), ("div", 'class="newsletter"'), ("div", 'class="subscribe"'),
        ("form", 'id="login"'), ("div", 'class="signup"'), ("fieldset", "")]
SHARE = [("div", 'class="share"'), ("div", 'class="social"'), ("ul", 'class="tags"'), ("div", 'class="byline"'),
         ("div", 'class="meta"'), ("div", 'class="hidden"'), ("div", 'style="display:none"')]
PAGES = 240
LOOSE_PAGES = 160


class _Writer:
    def __init__(self, seed: int):
        self.draw = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        letters = "aeioubcdlmnprst"
        count = self.draw.randint(low, high)
        return " ".join("".join(self.draw.choices(letters, k=self.draw.randint(2, 9))) for _ in range(count)).capitalize() + "."

    def links(self) -> str:
        items = "".join(f'<li><a href="#">{self.words(1, 3)}</a></li>' for _ in range(self.draw.randint(2, 7)))
        return f"<ul>{items}</ul>" if self.draw.random() < 0.7 else items.replace("li>", "div>")

    def prose(self, low: int = 1, high: int = 4) -> str:
        return "".join(f"<p>{self.words(1, 60)}</p>" for _ in range(self.draw.randint(low, high)))

    def wrap(self, part: tuple[str, str], inside: str, content: int) -> str:
        tag, attributes = part
        return f'<{tag} {attributes} data-content="{content}">{inside}</{tag}>'

    def boilerplate(self, kinds: list, inside: str) -> str:
        return self.wrap(self.draw.choice(kinds), inside, 0)

    def any_boilerplate(self) -> str:
        draw = self.draw
        line = lambda: draw.choice([self.words(1, 30), f"<p>{self.words(2, 30)}</p>", f"<div>{self.words(2, 20)}</div>"])
        comment = lambda: draw.choice([
            f'<div class="comment"><p>{self.words(1, 50)}</p></div>', f"<li>{self.prose(1, 2)}</li>", self.prose(1, 3)])
        return draw.choice([
            lambda: self.boilerplate(MENU, self.links()), lambda: self.boilerplate(SIDE, f"<h3>{self.words(1, 3)}</h3>" + self.links()),
            lambda: self.boilerplate(SIDE, self.prose(1, 3)), lambda: self.boilerplate(ADVERT, line()),
            lambda: self.boilerplate(NOTICE, line()), lambda: self.boilerplate(SHARE, line()),
            lambda: self.boilerplate(COMMENTS, "".join(comment() for _ in range(draw.randint(1, 4)))),
            lambda: self.boilerplate(FORM, f"<label>{self.words(1, 3)}</label><button>{self.words(1, 2)}</button>" + draw.choice(["", line()])),
        ])()

    def content(self) -> str:
        draw, parts = self.draw, []
        if draw.random() < 0.8:
            heading = f"<h1>{self.words(1, 12)}</h1>"
            parts.append(f"<header>{heading}</header>" if draw.random() < 0.15 else heading)
        for _ in range(draw.randint(1, 9)):
            parts.append(draw.choices([
                f"<p>{self.words(1, 80)}</p>", f"<p>{self.words(1, 4)}</p>", f"<h2>{self.words(1, 6)}</h2>",
                "<ul>" + "".join(f"<li>{self.words(1, 15)}</li>" for _ in range(draw.randint(1, 5))) + "</ul>",
                f"<blockquote><p>{self.words(3, 30)}</p></blockquote>",
                f'<p>{self.words(3, 30)} <a href="#">{self.words(1, 4)}</a> {self.words(1, 20)}</p>',
                f"<table><tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr></table>",
                f"<figure><figcaption>{self.words(2, 9)}</figcaption></figure>", f"<pre>{self.words(2, 20)}</pre>",
                f"<div>{self.words(3, 60)}</div>", f"<section><h2>{self.words(1, 5)}</h2>{self.prose()}</section>",
                self.any_boilerplate(),
            ], weights=[12, 5, 3, 2, 1, 3, 1, 1, 1, 2, 2, 5])[0])
        return "".join(parts)

    def page(self) -> str:
        draw = self.draw
        inside = self.wrap(draw.choice(ARTICLE), self.content(), 1)
        for _ in range(draw.randint(0, 2)):
            tag = draw.choice(['<div class="wrapper">', '<div id="page">', '<div class="row">', "<div>"])
            side = "".join(self.any_boilerplate() for _ in range(draw.randint(0, 2)))
            inside = f"{tag}{side if draw.random() < 0.4 else ''}{inside}{side}</div>"
        before = [self.boilerplate(HEADER, draw.choice([f"<h1>{self.words(1, 4)}</h1>", f"<p>{self.words(1, 9)}</p>", self.links()]))]
        before += [self.boilerplate(MENU, self.links())] + [self.any_boilerplate() for _ in range(draw.randint(0, 3))]
        after = [self.any_boilerplate() for _ in range(draw.randint(0, 3))]
        after += [self.boilerplate(FOOTER, draw.choice([self.words(2, 14), f"<p>{self.words(2, 14)}</p>", self.links()]))]
        body = "".join(x for x in before if draw.random() < 0.8) + inside + "".join(x for x in after if draw.random() < 0.9)
        page = f'<html><head><title>{self.words(1, 5)}</title></head><body data-content="0">{body}</body></html>'
        # Now and then a page leaves out what browsers add, or has no element around its text.
        if draw.random() < 0.1:
            page = body
        elif draw.random() < 0.1:
            bare = "".join(x for x in before if draw.random() < 0.7) + self.content() + "".join(after)
            page = f'<html><body data-content="1">{bare}</body></html>'
        return page

    def loose_text(self) -> str:
        """Text without a block element around it."""
        draw = self.draw
        run = lambda: draw.choice([
            self.words(1, 5), self.words(1, 60), self.words(10, 120), f"{self.words(1, 20)} <b>{self.words(1, 4)}</b> {self.words(1, 30)}",
            f'{self.words(3, 30)} <a href="#">{self.words(1, 3)}</a> {self.words(2, 20)}'])
        return draw.choice(["<br>", "<br><br>", " "]).join(run() for _ in range(draw.randint(1, 4)))

    def loose_page(self) -> str:
        """A page, or a part of one, whose text is loose, alone or between blocks; or with loose links beside an article."""
        draw = self.draw
        if draw.random() < 0.25:
            links = " | ".join(f'<a href="#">{self.words(1, 3)}</a>' for _ in range(draw.randint(1, 6)))
            body = links + self.wrap(draw.choice(ARTICLE), self.content(), 1) + draw.choice(["", links])
            content = 0
        else:
            parts, content = [self.loose_text()], 1
            for _ in range(draw.choice([0, 0, 1, 2, 4])):
                parts.append(draw.choice([
                    lambda: self.boilerplate(MENU, self.links()), lambda: self.boilerplate(FOOTER, self.words(2, 14)), self.any_boilerplate,
                    lambda: f"<div>{self.words(1, 60)}</div>", lambda: f"<h2>{self.words(1, 6)}</h2>", self.prose])())
                parts.append(self.loose_text())
            if draw.random() < 0.4:
                parts = [self.boilerplate(MENU, draw.choice([self.links(), f'<a href="#">{self.words(1, 2)}</a>'])), *parts,
                         self.boilerplate(FOOTER, self.words(1, 14))]
            body = "".join(parts)
        page = f'<body data-content="{content}">{body}</body>'
        return draw.choice([page, f"<html><head><title>{self.words(1, 5)}</title>{page}</html>"])


def labelled_pages(seed: int = 5) -> list[str]:
    writer, loose = _Writer(seed), _Writer(seed + 1)
    return [writer.page() for _ in range(PAGES)] + [loose.loose_page() for _ in range(LOOSE_PAGES)]
