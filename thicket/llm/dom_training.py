"""Labelled web pages made by rule, to train the node classifier of html_extract on."""

from __future__ import annotations

import random

_SYLLABLES = "an be co da el fi go ha in jo ka le mi no or pa qui re so ta un ve wa xe yo zu th er tion ing st ou".split()

# Names that sites give to their parts.
NAMES = {
    "nav": "nav navbar navigation menu main-menu breadcrumb breadcrumbs topnav pagination pager tabs".split(),
    "header": "header masthead site-header top-bar topbar logo branding page-header".split(),
    "footer": "footer site-footer copyright colophon bottom legal footnav".split(),
    "aside": "sidebar side widget widgets related recommended trending popular more-stories rail secondary tags".split(),
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion banner-ad ad-slot dfp".split(),
    "notice": "notice cookie cookie-notice cookies consent gdpr alert banner popup modal newsletter subscribe paywall announcement".split(),
    "comment": "comments comment comment-list respond responses discussion disqus replies reply reader-comments".split(),
    "share": "share social sharing follow buttons toolbar".split(),
    "content": "content main-content article article-body post post-content entry entry-content story story-body text body-text main page-content".split(),
}


#: How often a name says nothing: a word of the site's own.
STRANGE = 0.1


class PageMaker:
    def __init__(self, seed: int, names: dict[str, list[str]] = NAMES, strange: float = STRANGE):
        self.r, self.names, self.strange = random.Random(seed), names, strange

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def prose(self, low: int, high: int) -> str:
        style = self.r.random()
        text = ". ".join(self.words(3, 18).capitalize() + self.r.choice(["", ", " + self.words(2, 6)]) for _ in range(self.r.randint(low, high))) + "."
        if style < 0.1:
            return text.upper().replace(" ", "!! ")
        if style < 0.2:
            return " ".join(w + self.r.choice(["", "***", "&amp;&amp;", "%%%"]) for w in text.split())
        if style < 0.25:
            return " ".join([self.word()] * self.r.randint(5, 60))
        if style < 0.3:
            return " | ".join(self.words(1, 2) for _ in range(self.r.randint(3, 20)))
        return text

    def attrs(self, kind: str, often: float = 0.85) -> str:
        if self.r.random() > often:
            return ""
        name = self.word() if self.r.random() < self.strange else self.r.choice(self.names[kind])
        name = self.r.choice([name, name, f"{name} {self.word()}", f"{self.word()}-{name}", name.title().replace("-", "")])
        unseen = self.r.choice([" hidden", ' style="display: none"', ' aria-hidden="true"']) if kind in ("notice", "nav", "ad") and self.r.random() < 0.08 else ""
        return f' {self.r.choice(["class", "class", "id"])}="{name}"{unseen}'

    def tag(self, tag: str, inner: str, attrs: str = "", y: int | None = None) -> str:
        return f"<{tag}{attrs}{'' if y is None else f' data-y={y}'}>{inner}</{tag}>"

    def link(self) -> str:
        return f'<a href="/{self.word()}">{self.words(1, 3)}{self.r.choice(["", "", "", ".", ",", "!"])}</a>'

    def links(self, tag: str = "li") -> str:
        return "".join(self.tag(tag, self.link()) for _ in range(self.r.randint(2, 9)))

    def nav(self) -> str:
        inner = self.r.choice([self.tag("ul", self.links()), self.links("span"), " | ".join(self.link() for _ in range(self.r.randint(2, 7)))])
        return self.tag("nav", inner, self.attrs("nav", 0.3), 0) if self.r.random() < 0.6 else self.tag(self.r.choice(["div", "ul"]), inner, self.attrs("nav", 1), 0)

    def header(self) -> str:
        inner = self.tag(self.r.choice(["h1", "p", "div", "h2"]), self.words(1, 5)) + self.r.choice(["", self.nav(), self.tag("p", self.words(3, 9))])
        return self.tag("header", inner, self.attrs("header", 0.4), 0) if self.r.random() < 0.6 else self.tag("div", inner, self.attrs("header", 1), 0)

    def footer(self) -> str:
        inner = self.r.choice([f"&copy; {self.words(1, 4)} &middot; {self.prose(1, 4)}", self.tag("p", self.prose(1, 3)) + self.tag("ul", self.links())])
        return self.tag("footer", inner, self.attrs("footer", 0.3), 0) if self.r.random() < 0.65 else self.tag("div", inner, self.attrs("footer", 1), 0)

    def aside(self) -> str:
        inner = self.tag(self.r.choice(["h2", "h3", "p"]), self.words(1, 3)) + self.r.choice([self.tag("ul", self.links()), self.tag("p", self.prose(1, 4)), self.tag("div", self.tag("p", self.prose(1, 2)) + self.link())])
        return self.tag("aside", inner, self.attrs("aside", 0.4), 0) if self.r.random() < 0.6 else self.tag(self.r.choice(["div", "section"]), inner, self.attrs("aside", 1), 0)

    def ad(self) -> str:
        return self.tag(self.r.choice(["div", "div", "aside", "section", "p", "ins"]), self.r.choice([self.prose(1, 3), self.tag("p", self.prose(1, 4)), self.link(), self.prose(1, 2) + self.link()]), self.attrs("ad", 1), 0)

    def notice(self) -> str:
        inner = self.r.choice([self.prose(1, 3), self.tag("p", self.prose(1, 3))]) + self.r.choice(["", "<button>ok</button>", self.link()])
        return self.tag(self.r.choice(["div", "section", "p", "dialog"]), inner, self.attrs("notice", 1) + self.r.choice(["", ' role="alert"', ' role="dialog"']), 0)

    def form(self) -> str:
        return self.tag("form", self.tag("label", self.words(1, 3)) + "<input name=q>" + self.r.choice(["", self.tag("p", self.prose(1, 2)), "<textarea></textarea>"]) + "<button>go</button>", self.r.choice(["", ' class="search"', ' id="subscribe-form"']), 0)

    def share(self) -> str:
        return self.tag(self.r.choice(["div", "ul", "p"]), " ".join(self.link() for _ in range(self.r.randint(2, 5))), self.attrs("share", 1), 0)

    def comments(self) -> str:
        each = [self.tag(tag, self.r.choice([self.tag("p", self.prose(1, 6)), self.tag("b", self.word()) + self.tag("p", self.prose(1, 6)), self.prose(1, 4)]), self.attrs("comment", 0.7)) for tag in [self.r.choice(["div", "li", "article"])] for _ in range(self.r.randint(1, 8))]
        inner = self.tag(self.r.choice(["h2", "h3"]), self.words(1, 2)) + "".join(each) + self.r.choice(["", self.form()])
        return self.tag(self.r.choice(["div", "section", "ol"]), inner, self.attrs("comment", 1), 0)

    def inline(self, text: str) -> str:
        words = text.split(" ")
        for _ in range(self.r.randint(0, 2)):
            k = self.r.randrange(len(words))
            words[k] = self.r.choice(["<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<br>{}", "<i>{}</i>", "<span>{}</span>"]).format(words[k])
        return " ".join(words)

    def block(self) -> str:
        k = self.r.random()
        if k < 0.68:
            return self.tag("p", self.inline(self.prose(1, 9) if self.r.random() < 0.8 else self.words(1, 4).capitalize() + "."), self.r.choice(["", "", "", f' class="{self.word()}"']), 1)
        if k < 0.76:
            return self.tag(self.r.choice(["ul", "ol"]), "".join(self.tag("li", self.inline(self.prose(1, 2))) for _ in range(self.r.randint(2, 6))), "", 1)
        if k < 0.81:
            return self.tag("blockquote", self.r.choice([self.prose(1, 4), self.tag("p", self.prose(1, 4))]), "", 1)
        if k < 0.85:
            return self.tag("table", "".join(self.tag("tr", "".join(self.tag("td", self.words(1, 4)) for _ in range(3))) for _ in range(self.r.randint(2, 5))), "", 1)
        if k < 0.88:
            return self.tag("figure", "<img src=x>" + self.tag("figcaption", self.prose(1, 1)), "", 1)
        if k < 0.92:
            return self.tag("pre", self.words(5, 40), "", 1)
        return self.tag(self.r.choice(["h2", "h3"]), self.words(1, 6), "", 1)

    def content(self) -> str:
        blocks = [self.block() for _ in range(self.r.choice([1, 1, 2, 3, 5, 8, 14]))]
        if self.r.random() < 0.15:
            blocks = [self.tag("div", self.prose(1, 12), "", 1)]
        if self.r.random() < 0.25:
            blocks = [self.tag("section", "".join(blocks), self.attrs("content", 0.3))]
        for make, chance in ((self.ad, 0.12), (self.share, 0.15), (self.aside, 0.1), (self.form, 0.06), (self.nav, 0.06), (self.notice, 0.06)):
            if self.r.random() < chance:
                blocks.insert(self.r.randint(0, len(blocks)), make())
        title = self.tag("h1", self.words(2, 9), "", 1) if self.r.random() < 0.85 else ""
        if title and self.r.random() < 0.2:
            title = self.tag("header", title, "")
        inner = title + "".join(blocks)
        if self.r.random() < 0.12:
            inner += self.comments()
        if self.r.random() < 0.15:  # nothing around the article
            return inner
        tag = self.r.choice(["article", "article", "article", "main", "div", "div", "section"])
        return self.tag(tag, inner, self.attrs("content", 0.35 if tag in ("article", "main") else 0.85))

    def page(self) -> str:
        if self.r.random() < 0.08:  # nothing but text
            text = "".join(self.block() for _ in range(self.r.randint(1, 6)))
            return f"<html><head><title>{self.words(2, 6)}</title></head>{self.r.choice([text, self.tag('body', text)])}</html>"
        parts = [self.content()]
        if self.r.random() < 0.06:  # no article
            parts = [self.nav()]
        elif self.r.random() < 0.3:
            parts = [self.tag(self.r.choice(["main", "div"]), parts[0] + (self.comments() if self.r.random() < 0.3 else "") + (self.aside() if self.r.random() < 0.3 else ""), self.r.choice(["", ' class="wrapper"', ' id="container"', ' class="row"']))]
        for make, chance in ((self.header, 0.5), (self.nav, 0.7), (self.ad, 0.5), (self.notice, 0.3), (self.form, 0.2)):
            if self.r.random() < chance:
                parts.insert(0, make())
        at = len(parts)
        for make, chance in ((self.aside, 0.4), (self.comments, 0.35), (self.ad, 0.25), (self.notice, 0.15), (self.form, 0.15), (self.share, 0.1), (self.nav, 0.15), (self.footer, 0.8)):
            if self.r.random() < chance:
                parts.insert(self.r.randint(at, len(parts)) if make != self.footer else len(parts), make())
        body = "".join(parts)
        if self.r.random() < 0.25:
            body = self.tag("div", body, self.r.choice(["", ' id="page"', ' class="wrapper"', ' class="site"']))
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{}}</style></head><body>{body}</body></html>"


def labelled_pages(n: int, seed: int = 1, names: dict[str, list[str]] = NAMES, strange: float = STRANGE) -> list[str]:
    """Pages in which data-y=1 marks an element of the article, data-y=0 one that isn't; elements inside inherit."""
    return [PageMaker(seed * 100_000 + k, names, strange).page() for k in range(n)]
