"""Labelled pages, made by the seed: what stands in an element marked `data-main` is main text, in one marked `data-rest` it is not.

A template is a layout: which boxes a page has, in what order, by which elements they are made and how
they are named (by a speaking name, or by one that says nothing). Pages of a template differ in words.
Templates of even numbers are for learning, those of odd numbers for held-out tests. A template draws
its names from whole lists, or (to measure how pages with unknown names fare) from one half of each.
"""

from __future__ import annotations

import random

# How boxes are named on the web, by what they hold.
NAMES = {
    "main": "content post-content entry story article-body text main blog-post page-content prose body-copy node-content",
    "nav": "menu navbar main-nav navigation topnav site-links nav-list breadcrumbs tabs mega-menu",
    "header": "header masthead topbar site-title logo banner-top branding hero-bar",
    "footer": "footer copyright site-info bottom colophon imprint legal foot",
    "side": "sidebar widget trending popular aside rail right-col most-read more-news recommended",
    "notice": "cookie-notice consent gdpr alert popup modal overlay notification privacy-bar",
    "ad": "ad advert sponsored promo banner adsbox commercial partner-offer",
    "form": "newsletter subscribe signup search login contact-form",
    "share": "share social follow-us share-bar buttons like-box",
    "related": "related read-next you-may-like more-stories similar-posts recirc",
    "comments": "comments comment-list discussion responses disqus replies reader-comments feedback",
    "meta": "tags tag-cloud pagination pager author-links toolbar byline-links skip-link",
}
#: The element of a box where a page uses speaking elements.
ELEMENT = {"main": "article main", "nav": "nav", "header": "header", "footer": "footer", "side": "aside", "notice": "dialog div", "ad": "aside div", "form": "form", "share": "div", "related": "aside section", "comments": "section", "meta": "div"}
PLAIN = "x1 box wrap inner c-2 row block unit module item col-3 grid u-m w80"


class Template:
    def __init__(self, number: int, half: int | None = None) -> None:
        self.number, self.half = number, half
        self.r = r = random.Random(number * 7919 + 1)
        self.speaking_elements, self.named = r.random() < 0.6, r.random() < 0.75
        kinds = [k for k in NAMES if k != "main"]
        r.shuffle(kinds)
        chosen = [k for k in kinds if r.random() < 0.6]
        self.before = [k for k in chosen if k in ("nav", "header", "notice", "meta") or k in ("side", "ad", "form") and r.random() < 0.4]
        self.after = [k for k in chosen if k not in self.before]
        self.inside = [k for k in ("ad", "share", "related", "form", "side", "meta") if r.random() < 0.25]
        self.wrappers = r.randrange(0, 3)
        self.paragraph = r.choice(["<p>{}</p>"] * 6 + ["<div>{}</div>", "{}<br><br>", "<p>{}", "<div class=row><span>{}</span></div>"])
        self.loose = r.random() < 0.4  # boxes hold their words without paragraphs
        self.comment = r.choice(["div class=comment", "div", "article", "li"])
        self.naked = r.random() < 0.1  # nothing but the text
        self.bare = r.random() < 0.15  # main text straight in the body
        self.box = {k: self.opening(k) for k in NAMES}

    def opening(self, kind: str) -> tuple[str, str]:
        """The element of a box, and its attributes."""
        r = self.r
        element = r.choice(ELEMENT[kind].split()) if self.speaking_elements and r.random() < 0.85 else r.choice(["div", "div", "section"])
        names = NAMES[kind].split()
        own = {None: names, 0: names[: (len(names) + 1) // 2], 1: names[(len(names) + 1) // 2 :]}[self.half]
        named = self.named and r.random() < 0.85 or element in ("div", "section") and kind != "main"
        attributes = f" {r.choice(['class', 'class', 'id'])}=\"{r.choice(own)} {r.choice(PLAIN.split())}\"" if named else f' class="{r.choice(PLAIN.split())}"' if r.random() < 0.7 else ""
        return element, attributes

    def page(self, seed: int) -> str:
        return Page(self, random.Random(f"{self.number}/{seed}")).html()


class Page:
    def __init__(self, template: Template, r: random.Random) -> None:
        self.t, self.r = template, r
        self.words = ["".join(r.choice("bcdfghklmnprstvwz") + r.choice("aeiouäéñ") for _ in range(r.randrange(1, 4))) for _ in range(150)]

    def few(self, low: int, high: int) -> str:
        return " ".join(self.r.choice(self.words) for _ in range(self.r.randrange(low, high + 1)))

    def prose(self, sentences: int) -> str:
        out = []
        for _ in range(sentences):
            s = self.few(4, 18).split()
            if len(s) > 7:
                s[3] += ","
            out.append(" ".join(s).capitalize() + self.r.choice(".....?!"))
        return " ".join(out)

    def rich(self, text: str) -> str:
        """Some words of a paragraph linked or marked."""
        ws = text.split()
        for tag in ("a href=/x", "b", "em"):
            if self.r.random() < 0.25:
                i = self.r.randrange(len(ws))
                ws[i] = f"<{tag}>{ws[i]}</{tag.split()[0]}>"
        return " ".join(ws)

    def links(self, n: int, long: bool = False) -> str:
        return "<ul>" + "".join(f"<li><a href=/{i}>{self.few(4, 9) if long else self.few(1, 3)}</a></li>" for i in range(n)) + "</ul>"

    def box(self, kind: str) -> str:
        r = self.r
        inner = {
            "nav": lambda: self.links(r.randrange(3, 12)),
            "header": lambda: f"<a href=/>{self.few(1, 2)}</a> <span>{self.few(2, 6)}</span>" + (self.links(4) if r.random() < 0.4 else ""),
            "footer": lambda: f"<p>{r.choice(['&copy; ', '© 2020 ', '', ''])}{self.few(1, 12)}{r.choice(['.', ' &middot; ' + self.prose(1), ''])}</p>" + (self.links(5) if r.random() < 0.6 else "") + (f"<p>{self.prose(2)}</p>" if r.random() < 0.3 else ""),
            "side": lambda: f"<h3>{self.few(1, 3)}</h3>" + (self.links(r.randrange(3, 8), True) if r.random() < 0.7 else f"<p>{self.prose(r.randrange(1, 4))}</p>"),
            "notice": lambda: f"<p>{self.prose(r.randrange(1, 3))} <a href=/p>{self.few(1, 2)}</a></p><button>{self.few(1, 1)}</button>",
            "ad": lambda: self.few(3, 14) if r.random() < 0.5 else f"<p>{self.prose(1)}</p><a href=//ad>{self.few(2, 4)}</a>",
            "form": lambda: r.choice(["<label>{}</label>", "<p>{}</p>", "{} ", "{}<br>"]).format(self.few(1, 8)) + f"<input><button>{self.few(1, 2)}</button>",
            "share": lambda: "".join(f"<a href=#>{self.few(1, 1)}</a> " for _ in range(r.randrange(2, 6))),
            "related": lambda: f"<h3>{self.few(2, 3)}</h3>" + self.links(r.randrange(2, 6), True),
            "comments": lambda: f"<h3>{self.few(1, 2)}</h3>" + "".join(f"<{self.t.comment}><b>{self.few(1, 2)}</b> <time>{r.randrange(1, 30)} h</time><p>{self.prose(r.randrange(1, 4))}</p><a href=#>{self.few(1, 1)}</a></{self.t.comment.split()[0]}>" for _ in range(r.randrange(1, 7))),
            "meta": lambda: "".join(f"<a href=/t>{self.few(1, 2)}</a> " for _ in range(r.randrange(1, 6))),
        }[kind]()
        element, attributes = self.t.box[kind]
        if self.t.loose:
            inner = inner.replace("<p>", "").replace("</p>", " ")
        return f"<{element}{attributes} data-rest>{inner}</{element}>"

    def main(self) -> str:
        r, out = self.r, []
        out.append(f"<h1>{self.few(3, 10)}</h1>")
        if r.random() < 0.3:
            out.append(f"<p class=lead>{self.prose(1)}</p>")
        for _ in range(r.randrange(2, 12)):
            x = r.random()
            if x < 0.68:
                out.append(self.t.paragraph.format(self.rich(self.prose(r.randrange(1, 6)))))
            elif x < 0.76:
                out.append(f"<h2>{self.few(2, 6)}</h2>")
            elif x < 0.84:
                out.append("<ul>" + "".join(f"<li>{self.rich(self.prose(1) if r.random() < 0.6 else self.few(1, 6))}</li>" for _ in range(r.randrange(2, 6))) + "</ul>")
            elif x < 0.89:
                out.append(f"<blockquote>{self.prose(2)}</blockquote>")
            elif x < 0.93:
                out.append("<table>" + "".join(f"<tr><td>{self.few(1, 3)}</td><td>{self.few(1, 4)}</td></tr>" for _ in range(r.randrange(2, 5))) + "</table>")
            elif x < 0.97:
                out.append(f"<figure><img><figcaption>{self.few(3, 9)}</figcaption></figure>")
            else:
                out.append(f"<pre>{self.few(5, 20)}</pre>")
        for kind in self.t.inside:
            out.insert(r.randrange(1, len(out) + 1), self.box(kind))
        return "".join(out)

    def html(self) -> str:
        element, attributes = self.t.box["main"]
        if self.t.naked:
            text = "\n".join(self.t.paragraph.format(self.prose(self.r.randrange(1, 6)) if self.r.random() < 0.7 else self.few(1, 8)) for _ in range(self.r.choice([1, 1, 2, 3, 5])))
            return f"<body data-main>{text}</body>"
        if self.t.bare:
            element, attributes = "div", ""
        main = f"<{element}{attributes} data-main>{self.main()}</{element}>"
        for _ in range(self.t.wrappers):
            main = f'<div class="{self.r.choice(PLAIN.split())}">{main}</div>'
        boxes = lambda kinds: "".join(map(self.box, kinds))
        return f"<!DOCTYPE html><html><head><title>{self.few(2, 6)}</title></head><body>{boxes(self.t.before)}{main}{boxes(self.t.after)}</body></html>"


def pages(templates: int, each: int = 2, held_out: bool = False, half: int | None = None) -> list[str]:
    """So many pages of each of so many templates."""
    return [t.page(i) for t in (Template(2 * n + held_out, half) for n in range(templates)) for i in range(each)]
