"""Labelled pages for training and tests: layouts composed from parts, with invented words and a fixed seed.

Elements carry data-main="1" where the article is and "0" where something else stands inside it. Class and id names
are the usual ones of page templates; which of them a page has, and whether it has any, is drawn.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

# Names that templates commonly give to their parts.
NAMES = {
    "header": "header masthead site-header top topbar page-header banner branding logo hero".split(),
    "menu": "nav menu navbar navigation main-nav topnav breadcrumb breadcrumbs toc links pagination pager sitemap submenu".split(),
    "notice": "cookie-notice cookie-banner consent gdpr notice alert message cookies privacy-notice info-bar popup modal overlay warning disclaimer cookie note".split(),
    "advert": "ad ads advert advertisement ad-slot sponsored sponsor promo promotion banner-ad google-ad adsbygoogle adbox commercial".split(),
    "side": "sidebar side aside widget rail secondary column-right related related-posts recommended trending popular more tags share sharing social author-bio see-also".split(),
    "form": "subscribe newsletter signup login search search-form contact-form poll".split(),
    "comments": "comments comment-list comments-area responses replies discussion disqus reader-comments feedback user-comments comment thread reply".split(),
    "footer": "footer site-footer bottom colophon copyright legal site-info foot".split(),
    "main": "content main main-content article post entry story entry-content post-content article-body story-body post-body text body article-content".split(),
}
_SYLLABLES = "the an er in on re ti es or en at ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur ñó ü ê ß".split()


class Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int, cue: str = "") -> str:
        out = [self.word() for _ in range(self.r.randint(low, high))]
        if cue:
            out.insert(self.r.randrange(len(out) + 1), cue)
        return self.r.choice([str.capitalize, str])(" ".join(out))

    def prose(self, low: int = 1, high: int = 5) -> str:
        cues = ["", "", "", "", "", "License", "comment", "privacy", "search", "&copy;", "copyright", "next", "terms", "rights"]
        return " ".join(self.words(1, 22, self.r.choice(cues)) + self.r.choice([".", ".", ".", "!", "?", ""]) for _ in range(self.r.randint(low, high)))

    def named(self, kind: str, tags: str, inner: str, main: str = "") -> str:
        """An element of one of `tags` with names of its kind, or with none where the tag says enough."""
        tag = self.r.choice(tags.split())
        names = self.r.sample(NAMES[kind], self.r.choice([1, 1, 2]))
        if self.r.random() < 0.3:
            names.append(self.word())
        said = "" if tag in ("nav", "footer", "header", "aside", "form", "article", "main") and self.r.random() < 0.5 else f' {self.r.choice(["class", "class", "id"])}="{" ".join(names)}"'
        return f"<{tag}{said}{main}>{inner}</{tag}>"

    def links(self, low: int = 2, high: int = 9) -> str:
        one = [f'<a href="/{self.word()}">{self.words(1, 4)}</a>' for _ in range(self.r.randint(low, high))]
        return self.r.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in one) + "</ul>", " | ".join(one), " ".join(f"<span>{x}</span>" for x in one), "".join(f"<div>{x}</div>" for x in one)])

    def menu(self) -> str:
        return self.named("menu", "nav nav div ul div", self.links())

    def header(self) -> str:
        inner = self.r.choice(["", f"<h1>{self.words(1, 4)}</h1>", f'<a href="/"><img src="x.png">{self.words(1, 3)}</a>']) + f"<p>{self.words(2, 9)}</p>" * self.r.choice([0, 1])
        return self.named("header", "header header div", inner + self.r.choice(["", self.menu(), self.form()]))

    def notice(self) -> str:
        cue = self.r.choice(["cookies", "consent", "privacy", ""])
        inner = self.r.choice(["<p>{}</p>", "{}", "<div>{}</div>"]).format(self.words(5, 25, cue) + ".") + self.r.choice(["", "<button>OK</button>", '<a href="#">Accept</a>'])
        return self.named("notice", "div div section aside", inner)

    def advert(self) -> str:
        inner = self.r.choice([self.words(3, 12) + ".", f"<p>{self.prose(1, 2)}</p>", f'<a href="http://x">{self.words(2, 6)}</a>', f"<span>Advertisement</span><p>{self.words(2, 9)}</p>"])
        return self.named("advert", "div div aside section", inner)

    def form(self) -> str:
        fields = "".join(f"<label>{self.word()}</label><input name=a>" for _ in range(self.r.randint(0, 3)))
        return self.named("form", "form form div", f"<p>{self.words(2, 14)}</p>" * self.r.choice([0, 1]) + f"<form>{fields}<select><option>{self.word()}<option>{self.word()}</select><button>Send</button></form>")

    def side(self) -> str:
        inner = "".join(self.r.choice([lambda: f"<h3>{self.words(1, 4)}</h3>", self.links, lambda: f"<p>{self.prose(1, 2)}</p>", self.advert, self.form])() for _ in range(self.r.randint(1, 4)))
        return self.named("side", "aside aside div section", inner)

    def comments(self) -> str:
        def one() -> str:
            said = f'<p class="author">{self.words(1, 2)}</p>' * self.r.choice([0, 1]) + "".join(f"<p>{self.prose(1, 3)}</p>" for _ in range(self.r.randint(1, 2)))
            return self.r.choice([f'<div class="comment">{said}</div>', f"<li>{said}</li>", f'<article class="comment">{said}</article>', f"<div>{said}</div>"])

        return self.named("comments", "section div div ol", f"<h3>{self.r.randint(2, 40)} comments</h3>" * self.r.choice([0, 1]) + "".join(one() for _ in range(self.r.randint(1, 4))))

    def footer(self) -> str:
        inner = self.r.choice([f"&copy; {self.word()}.example &middot; {self.prose(1, 2)}", f"<p>Copyright {self.words(1, 5)}. All rights reserved.</p>", self.links(), f"<p>{self.prose(1, 2)}</p>" + self.links()])
        return self.named("footer", "footer footer div", inner)

    def outside(self, *kinds: str) -> str:
        return "".join(getattr(self, k)() for k in kinds if self.r.random() < 0.6)

    def paragraph(self) -> str:
        text = self.prose()
        if self.r.random() < 0.2:
            text = f'{text} <a href="/x">{self.words(1, 4)}</a> {self.words(1, 6)}.'
        return self.r.choice([f"<p>{text}</p>"] * 5 + [f"<p>{self.word().capitalize()}.</p>", f"<p><b>{text}<br><p>{self.prose()}</p>", f"<p>{text}<br>{self.prose()}</p>", f"<p><em>{text}</em></p>"])

    def story(self) -> str:
        """What an article is made of, with other things inside it at times."""
        out = [f"<h1>{self.words(2, 10)}</h1>"] if self.r.random() < 0.7 else []
        for _ in range(self.r.choice([1, 2, 5, 9, 14])):
            out.append(self.paragraph())
            if self.r.random() < 0.25:
                items = [self.prose(1, 2) for _ in range(self.r.randint(1, 5))]
                out.append(self.r.choice([
                    f"<h2>{self.words(1, 7)}</h2>", f"<h3>{self.words(1, 7)}</h3>", "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", "<ol>" + "".join(f"<li>{x}" for x in items) + "</ol>",
                    f"<blockquote><p>{items[0]}</p></blockquote>", f"<pre>{items[0]}</pre>", "<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{x}</td></tr>" for x in items) + "</table>",
                    f"<figure><img src=a.png><figcaption>{items[0]}</figcaption></figure>", f"<div>{items[0]}</div>", f"<section><p>{items[0]}</p></section>",
                ]))
            if self.r.random() < 0.1:
                out.append(self.inner(self.r.choice([self.advert, self.side, self.form, self.notice, self.menu])()))
        if self.r.random() < 0.15:
            out[:1] = ["<header>" + out[0] + "</header>"]
        return "".join(out) + "".join(self.inner(f()) for f, share in ((self.side, 0.2), (self.comments, 0.25), (self.footer, 0.1)) if self.r.random() < share)

    @staticmethod
    def inner(html: str) -> str:
        tag, rest = html[1:].split(">", 1)
        return f'<{tag} data-main="0">{rest}'

    def html(self) -> str:
        main, story = ' data-main="1"', self.story()
        body = self.r.choice([
            lambda: f"<article{main}>{story}</article>",
            lambda: f"<article{main}>{story}</article>",
            lambda: self.named("main", "article main div", story, main),
            lambda: f"<main><article{main}>{story}</article></main>",
            lambda: f'<div id="{self.r.choice(["content", "main", "page"])}">' + self.named("main", "div div section", story, main) + "</div>",
            lambda: self.named("main", "div", story, main),
            lambda: f"<div{main}>{story}</div>",
            lambda: f"<main{main}>{story}</main>",
            lambda: f"<div><div{main}>{story}</div></div>",
            lambda: f'<table><tr><td>{self.menu()}</td><td{self.r.choice(["", " class=main"])}{main}>{story}</td></tr></table>',
        ])()
        if self.r.random() < 0.08:  # nothing else on the page
            return self.r.choice([f"<html><body{main}><div{main}>{story}</div>", f"<div{main}>{self.prose()}</div>", f"<div{main}>{story}</div>"])
        before, after = self.outside("notice", "header", "menu", "advert"), self.outside("side", "form", "comments", "advert", "menu", "notice", "footer")
        if self.r.random() < 0.15:  # a column of its own before the article
            before += self.side()
        head = f"<head><title>{self.words(2, 9)}</title><style>p{{}}</style><script>var t='</p>';</script></head>"
        wrap = self.r.choice(["{}", "{}", '<div class="wrapper">{}</div>', '<div id="page"><div class="container">{}</div></div>'])
        return f'<!DOCTYPE html><html lang="en">{head}<body>{wrap.format(before + "<!-- x -->" + body + after)}</body></html>'


def labelled(count: int, seed: int = 0) -> Iterator[str]:
    for k in range(count):
        yield Page(seed * 1_000_003 + k).html()
