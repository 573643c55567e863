"""Generated web pages whose main blocks are known, to fit and to measure the classifier of ``html_extract``.

Pages are drawn from families of layouts: semantic elements, named ``div`` elements, bare ``div`` elements and tables. Each
has some of a menu, header, notices, adverts, sidebar, related links, forms, reader comments and footer around or
inside an article of headings, paragraphs of all lengths, lists, quotations, code and linked lines. The same seed gives
the same pages.
"""

from __future__ import annotations

import numpy as np

FAMILIES = ("semantic", "named", "bare", "table")
_SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe qui ro su ta ve wi xo zu".split()
_MONTHS = "Jan Feb March April May June July Aug Sept Oct Nov Dec".split()
#: Names of elements by what they hold; plain examples, as themes use them.
NAMES = {
    "article": ["post-content", "entry", "article-body", "story", "content"],
    "menu": ["nav-bar", "menu", "top-nav", "navigation"],
    "ad": ["ad", "advert", "sponsored", "promo-box"],
    "notice": ["cookie-notice", "consent", "notice", "newsletter"],
    "sidebar": ["sidebar", "widget-area", "right-sidebar"],
    "related": ["related", "recommended", "share-links"],
    "comments": ["comments", "comment-list", "replies"],
    "footer": ["footer", "page-footer", "copyright"],
    "subject": ["share", "social", "policy-notice", "copyright", "search", "promo", "related", "banner", "header", "menu", "sponsor"],
    "wrapper": ["wrapper", "layout has-sidebar", "page with-comments", "container", "site no-sidebar"],
}


class _Page:
    def __init__(self, rng: np.random.Generator, family: str):
        self.rng, self.family, self.main, self.used = rng, family, [], set()

    def pick(self, values: list[str]) -> str:
        return values[int(self.rng.integers(len(values)))]

    def sentence(self, words: int, mark: bool = True) -> str:
        """A line of ``words`` words that the page has nowhere else."""
        while True:
            line = " ".join("".join(self.pick(_SYLLABLES) for _ in range(int(self.rng.integers(1, 4)))) for _ in range(words)).capitalize()
            if line not in self.used:
                self.used.add(line)
                return line + (self.pick([".", ".", "!", "?"]) if mark else "")

    def prose(self, upto: int = 6) -> str:
        return " ".join(self.sentence(int(self.rng.integers(4, 16))) for _ in range(int(self.rng.integers(1, upto))))

    def kept(self, text: str) -> str:
        self.main.append(text)
        return text

    def element(self, kind: str, inner: str, tag: str) -> str:
        """``inner`` as the family marks up what it is."""
        if self.family == "semantic":
            return f"<{tag}>{inner}</{tag}>"
        if self.family == "named":
            return f'<div class="{self.pick(NAMES[kind])}">{inner}</div>'
        return f"<div>{inner}</div>"

    def links(self, most: int = 9) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{self.sentence(int(self.rng.integers(1, 4)), False)}</a></li>' for k in range(int(self.rng.integers(3, most)))) + "</ul>"

    def hinted(self, main: bool) -> str:
        """A part of an article whose name has a word of notices beside a word of no list: a subject, or a notice of this theme."""
        name = f"{self.sentence(1, False).lower()}-{self.pick(NAMES['subject'])}"
        if main:
            inner = f"<h2>{self.kept(self.sentence(3, False))}</h2>" * int(self.rng.integers(2)) + "".join(f"<p>{self.kept(self.prose(5))}</p>" for _ in range(int(self.rng.integers(1, 4))))
        else:
            inner = self.links(5) if self.rng.random() < 0.7 else f"<span>{self.sentence(2, False)}</span>"
        tag = self.pick(["div", "section"])
        return f'<{tag} class="{name}">{inner}</{tag}>'

    def article(self) -> str:
        parts = [f"<h1>{self.kept(self.sentence(6, False))}</h1>"]
        for _ in range(int(self.rng.integers(3, 12))):
            kind = self.rng.random()
            if kind < 0.55:
                parts.append(f"<p>{self.kept(self.prose())}</p>")
            elif kind < 0.62:
                parts.append(f"<p>{self.kept(self.sentence(int(self.rng.integers(1, 4))))}</p>")
            elif kind < 0.65:
                parts.append(f"<p>{self.kept(f'{self.sentence(2, False)}, {self.when()}')}</p>")
            elif kind < 0.72:
                parts.append(f"<h2>{self.kept(self.sentence(4, False))}</h2>")
            elif kind < 0.80:
                parts.append("<ul>" + "".join(f"<li>{self.kept(self.sentence(int(self.rng.integers(2, 9))))}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.86:
                parts.append(f"<blockquote>{self.kept(self.prose(3))}</blockquote>")
            elif kind < 0.90:
                parts.append(f"<pre>{self.kept(self.sentence(5, False))}</pre>")
            elif kind < 0.95:
                parts.append(f'<p><a href="/x">{self.kept(self.sentence(5, False))}</a></p>')
            elif self.family in ("semantic", "named") and kind < 0.97:
                parts.append(f'<div {self.pick(["hidden", 'style="display:none"', 'aria-hidden="true"'])}>{self.prose(3)}</div>')
            elif self.family in ("semantic", "named"):
                parts.append(f'<div class="{self.pick(NAMES["ad"])}">{self.prose(3)}</div>')
        if self.family in ("semantic", "named") and self.rng.random() < 0.5:
            parts.insert(int(self.rng.integers(1, len(parts) + 1)), self.hinted(self.rng.random() < 0.5))
        return "".join(parts)

    def when(self) -> str:
        rng = self.rng
        return self.pick([f"{int(rng.integers(1, 29))} {self.pick(_MONTHS)} {int(rng.integers(2001, 2026))}", f"{int(rng.integers(2, 24))} hours ago", f"{int(rng.integers(1, 24))}:{int(rng.integers(10, 60))}", f"{int(rng.integers(2001, 2026))}-{int(rng.integers(1, 13)):02d}-{int(rng.integers(1, 29)):02d}"])

    def thread(self) -> str:
        """Readers' comments that no name tells of: like parts, each with a line of who and when."""
        item, name = self.pick(["li", "div", "article", "section"]), self.sentence(1, False).lower()
        shape = self.pick(['<p><b>{who}</b> {when}</p>', "<div>{who}, {when}</div>", "<h4>{who}</h4><span>{when}</span>"])
        parts = "".join(f"<{item}>{shape.format(who=self.sentence(2, False), when=self.when())}<p>{self.prose(4)}</p></{item}>" for _ in range(int(self.rng.integers(2, 7))))
        head = f"<h2>{self.sentence(1, False)}</h2>" if self.rng.random() < 0.6 else ""
        return f'{head}<ul id="{name}">{parts}</ul>' if item == "li" else f'{head}<div id="{name}">{parts}</div>'

    def comments(self) -> str:
        if self.rng.random() < 0.5:
            return self.thread()
        inner = "".join(f'<div class="comment-body"><p>{self.prose(4)}</p></div>' if self.family != "bare" else f"<p>{self.sentence(5)}</p>" for _ in range(int(self.rng.integers(2, 6))))
        return f'<section class="{self.pick(NAMES["comments"])}">{inner}</section>'

    def build(self) -> str:
        rng, told = self.rng, self.family in ("semantic", "named")
        before = [self.element("menu", self.links(), "nav")]
        if told and rng.random() < 0.5:
            before.insert(0, f'<div class="{self.pick(NAMES["notice"])}">{self.prose(3)}</div>')
        if rng.random() < 0.5:
            before.insert(0, self.element("menu", self.sentence(3, False), "header"))
        after = []
        if rng.random() < 0.6:
            after.append(self.element("sidebar", f"<h3>{self.sentence(2, False)}</h3>" + self.links(), "aside"))
        if rng.random() < 0.4:
            after.append(self.element("related", self.links(5), "aside"))
        if told and rng.random() < 0.4:
            after.append(f"<form><label>{self.sentence(2, False)}</label><button>{self.sentence(1, False)}</button></form>")
        after.append(self.element("footer", f"<p>{self.sentence(int(rng.integers(3, 9)))}</p>", "footer"))
        body = self.article()
        comments = (self.comments() if told else self.thread()) if rng.random() < 0.5 else ""
        inside = rng.random() < 0.5
        if self.family == "semantic":
            tag = self.pick(["article", "main"])
            core = f"<{tag}>{body}{comments if inside else ''}</{tag}>{'' if inside else comments}"
        elif self.family == "named":
            core = f'<div class="{self.pick(NAMES["article"])}">{body}{comments if inside else ""}</div>{"" if inside else comments}'
        elif self.family == "table":
            core = f"<table><tr><td>{self.links(5)}</td><td>{body}{comments}</td></tr></table>"
        else:
            core = f"<div>{body}{comments if inside else ''}</div>{'' if inside else comments}"
        order = [*before, core, *after]
        wrapper = self.pick(NAMES["wrapper"]) if told else ""
        return f'<!DOCTYPE html><html><head><title>{self.sentence(4, False)}</title></head><body><div class="{wrapper}">{"".join(order)}</div></body></html>'


def labelled_pages(many: int, seed: int, families: tuple[str, ...] = FAMILIES) -> list[tuple[str, list[str]]]:
    """``many`` pages and the texts of the main blocks of each, in page order."""
    rng, out = np.random.default_rng(seed), []
    for k in range(many):
        page = _Page(rng, families[k % len(families)])
        out.append((page.build(), page.main))
    return out
