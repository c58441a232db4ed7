"""HTML extraction: a recurrent labeller reads a page's leaf blocks and keeps its article.

A page is cut into leaf blocks (html_blocks). A block's vector is: the mean of the hashed
features of all elements above it (tag names, words of class, id, role and itemprop), those of
the innermost two elements by themselves, the mean of the vectors of all its words (hashed),
and some measures (sizes, share of links, of punctuation, of digits, place in the page). A
bidirectional LSTM in numpy reads the blocks of the whole page from both ends and says
which ones belong to the article, so a block is judged by all that stands around it.

The network is trained here, by backpropagation through time, on pages that are made for it
(made_pages): layouts with semantic elements, with speaking or with meaningless class
names, with tables; menus, headers, notices, adverts, forms, sidebars, comments and footers
around and within articles. Their words are the wording of such parts in four languages and the
words of a bounded sample of the given pages (SAMPLE_PAGES). Pages of that sample are read too, as far as
their own semantic elements leave no doubt (sure_labels).

A page is one row from html to text; the only thing that is sent to tasks is the network (1 MB).

Defined results. A null or empty html, and a page without blocks that the network keeps, give
an empty text. Rows without page_id, repeated rows and long pages are pages like any other.
Other columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .html_blocks import PATH_ROWS, Page, features

#: Rows of the word table; sizes of path, inner and word vectors; hidden units of a direction.
WORD_ROWS, PATH, INNER, WORD, HIDDEN = 8192, 20, 12, 12, 24
#: Pages whose words are borrowed; pages that are made; steps and pages of training.
SAMPLE_PAGES, MADE, STEPS, BATCH = 128, 1400, 560, 32
MEASURES = 14
#: How often a page with sure labels is laid among the made ones.
KNOWN_TIMES = 3
_MARK = ""  # stands in made pages before what belongs to the article
_OPEN = ""  # before what may or may not
_PUNCT, _DIGIT, _UPPER = W.table([(33, 47), (58, 63)]), W.table([(48, 57)]), W.table([(65, 90)])


# Made pages -----------------------------------------------------------------------------------

#: The wording of parts that are not the article.
MENU = "Home|About|Contact|News|Sports|Business|Login|Sign up|Search|Shop|Blog|Archive|Help|Products|Services|Startseite|Über uns|Kontakt|Anmelden|Suche|Nachrichten|Accueil|À propos|Connexion|Recherche|Actualités|Inicio|Acerca de|Contacto|Noticias|Buscar|Iniciar sesión".split("|")
NOTICE = "We use cookies to improve your experience.|This site uses cookies. By continuing you accept our privacy policy.|Accept all|Reject|Wir verwenden Cookies auf dieser Seite.|Nous utilisons des cookies.|Usamos cookies en este sitio.|You have 3 free articles left this month.|Please enable JavaScript.|Notice: this page was archived.|Breaking: follow our live updates".split("|")
AD = "Advertisement|Sponsored|Buy now and save 50%|Anzeige|Publicité|Publicidad|Limited offer, click here|Download our app today|Best deals of the week".split("|")
FOOT = "© 2024 All rights reserved.|Privacy Policy|Terms of Service|Impressum|Datenschutz|Mentions légales|Aviso legal|Powered by|Contact us|Sitemap|Follow us on social media|Copyright".split("|")
FORM = "Subscribe to our newsletter|Your email address|Name|Email|Submit|Send|Password|Message|Abonnieren|S'abonner|Suscribirse|Search|Sign up for updates|Get the latest stories in your inbox.".split("|")
SIDE = "Related articles|Most read|Trending|Popular posts|Recent posts|Tags|Categories|Share this|Read more|See also|Archives|Follow us|Ähnliche Artikel|Articles liés|Más leídos".split("|")
TALK = "Reply|Comments|3 comments|Leave a comment|Posted by|says:|2 hours ago|Like|Report|Antworten|Kommentare|Répondre|Commentaires|Responder|Comentarios|Great article, thanks!|I disagree with this.|First!".split("|")
CLASSES = {
    "menu": "nav navbar menu main-menu navigation topnav breadcrumb breadcrumbs site-nav nav-links mainNav menu-item dropdown",
    "head": "header site-header masthead top-bar banner logo branding page-header siteHeader topbar hero-bar",
    "foot": "footer site-footer bottom copyright page-footer colophon siteFooter legal foot",
    "side": "sidebar side widget aside related related-posts recommended trending rail popular sidebar-right promo-list tags share social more-stories",
    "note": "notice cookie cookie-banner alert consent gdpr message banner-notice warning paywall notification popup modal",
    "ad": "ad ads advert advertisement sponsored promo banner-ad adsbygoogle ad-slot ad-container commercial",
    "form": "form newsletter subscribe signup search search-form login contact-form mailing",
    "talk": "comments comment comment-list comment-body discussion responses replies reader-comments disqus feedback commentlist user-comments",
    "text": "article content post entry post-content article-body entry-content main main-content story story-body text body-text article__content post-body page-content articleBody blog-post",
}
CLASSES = {k: v.split() for k, v in CLASSES.items()}
TAGS = {"menu": ["nav"], "head": ["header"], "foot": ["footer"], "side": ["aside"], "note": ["div", "aside", "section"], "ad": ["div", "aside", "ins"], "form": ["form"], "talk": ["section", "div"], "text": ["article", "main", "section"]}


class Maker:
    """One made page."""

    def __init__(self, draw: random.Random, words: list[str]):
        self.draw, self.words = draw, words
        self.style = draw.choices(["tags", "names", "blank"], [4, 4, 2])[0]
        self.closed = draw.random() < 0.75  # whether p and li get end tags
        self.noise = draw.choice([0, 0, 0.1, 0.4])  # of odd characters behind words
        self.lines = draw.choice(["p", "p", "p", "p", "div", "br"])

    def chance(self, p: float) -> bool:
        return self.draw.random() < p

    def prose(self, low: int, high: int) -> str:
        out = []
        for _ in range(self.draw.randint(low, high)):
            some = [self.draw.choice(self.words) for _ in range(self.draw.randint(1, 22))]
            if self.noise:
                some = [w + (self.draw.choice(["&amp;", "***", "%%%", "###", "&quot;"]) if self.chance(self.noise) else "") for w in some]
            out.append(" ".join(some).capitalize() + self.draw.choice([".", ".", ".", ".", "?", "!", ""]))
        text = " ".join(out)
        if self.chance(0.25):
            cut = text.split(" ")
            k = self.draw.randrange(len(cut))
            tag = self.draw.choice(["b", "i", "em", "strong", "span", "code", 'a href="/x"', 'a href="https://example.org/a?b=c&amp;d=e"'])
            cut[k] = f"<{tag}>{cut[k]}</{tag.split()[0]}>"
            text = " ".join(cut)
        return text

    def few(self) -> str:
        return " ".join(self.draw.choice(self.words) for _ in range(self.draw.randint(1, 5)))

    def said(self, phrases: list[str]) -> str:
        return self.draw.choice(phrases) if self.chance(0.55) else self.few() if self.chance(0.6) else self.prose(1, 2)

    def wrap(self, kind: str, inner: str) -> str:
        tag = self.draw.choice(TAGS[kind]) if self.style == "tags" and self.chance(0.85) or kind == "form" else self.draw.choice(["div", "div", "div", "section", "td"] if kind != "text" else ["div", "div", "section"])
        if tag == "td":
            return f"<table><tr><td{self.named(kind)}>{inner}</td></tr></table>"
        return f"<{tag}{self.named(kind)}>{inner}</{tag}>"

    def named(self, kind: str) -> str:
        if self.style == "blank" and kind != "form":
            return self.draw.choice(["", f' class="{"".join(self.draw.choice("abcdefxyz") for _ in range(5))}"'])
        if self.style == "tags" and self.chance(0.5):
            return ""
        name = self.draw.choice(CLASSES[kind])
        if self.chance(0.3):
            name += " " + self.draw.choice(["row", "col-8", "wrapper", "clearfix", "container", "mt-4", "inner", "box", "js-track"])
        return f' {self.draw.choice(["class", "class", "class", "id"])}="{name}"'

    def links(self, phrases: list[str], low: int, high: int) -> str:
        items = [f'<a href="/{k}">{self.draw.choice(phrases) if self.chance(0.5) else self.few()}</a>' for k in range(self.draw.randint(low, high))]
        if self.chance(0.75):
            return "<ul>" + "".join(f"<li>{i}</li>" if self.closed else f"<li>{i}" for i in items) + "</ul>"
        return self.draw.choice([" | ", " ", "<br>", " &middot; "]).join(items)

    def part(self, kind: str) -> str:
        d = self.draw
        if kind == "menu":
            return self.wrap(kind, self.links(MENU, 3, 12))
        if kind == "head":
            return self.wrap(kind, d.choice(["<h1>{}</h1>", '<a href="/">{}</a>', '<div class="logo">{}</div>', "<p>{}</p>"]).format(self.few()) + (f"<p>{self.said(MENU)}</p>" if self.chance(0.4) else "") + (self.links(MENU, 2, 8) if self.chance(0.4) else ""))
        if kind == "foot":
            return self.wrap(kind, d.choice(["{}", "<p>{}</p>", "<div>{}</div>", "<small>{}</small>"]).format(d.choice(["&copy; ", "", "© 2024 "]) + self.said(FOOT) + d.choice(["", " &middot; " + self.few()])) + (self.links(FOOT, 2, 8) if self.chance(0.5) else ""))
        if kind == "side":
            return self.wrap(kind, (f"<h{d.choice('234')}>{self.said(SIDE)}</h3>" if self.chance(0.7) else "") + (self.links(SIDE, 2, 8) if self.chance(0.7) else "") + (f"<p>{self.prose(1, 3)}</p>" if self.chance(0.5) else "") + (f"<div>{self.few()}</div>" if self.chance(0.3) else ""))
        if kind == "note":
            return self.wrap(kind, d.choice(["{}", "<p>{}</p>", "<span>{}</span>"]).format(self.said(NOTICE)) + (f"<button>{self.said(NOTICE)}</button>" if self.chance(0.4) else ""))
        if kind == "ad":
            return self.wrap(kind, d.choice(["{}", "{}", "<p>{}</p>", '<a href="/ad">{}</a>']).format(self.said(AD)))
        if kind == "form":
            return self.wrap(kind, d.choice(["", f"<h3>{self.said(FORM)}</h3>", f"<p>{self.said(FORM)}</p>"]) + f"<label>{self.said(FORM)}</label><input type=text>" + d.choice(["", f"<select><option>{self.few()}</select>", f"<textarea>{self.few()}</textarea>"]) + f"<button>{self.said(FORM)}</button>")
        inner = f"<h{d.choice('234')}>{self.said(TALK)}</h3>" if self.chance(0.7) else ""
        kind_of = d.choice(["li", "div", "article", "div"])
        for _ in range(d.randint(1, 6)):
            name = self.named("talk") if self.chance(0.7) else ""
            who = d.choice(["", f"<b>{self.few()}</b>", f'<span class="author">{self.few()}</span> ', f"<div>{self.few()}</div>"])
            said = d.choice(["<p>{}</p>", "{}", "<div>{}</div>"]).format(self.said(TALK) if self.chance(0.4) else self.prose(1, 4))
            inner += f"<{kind_of}{name}>{who}{said}{d.choice(['', '<a href=#>' + d.choice(TALK) + '</a>'])}</{kind_of}>"
        return self.wrap("talk", f"<ol>{inner}</ol>" if kind_of == "li" else inner) + (self.part("form") if self.chance(0.3) else "")

    def paragraph(self) -> str:
        text = _MARK + (self.few().capitalize() + "." if self.chance(0.12) else self.prose(1, self.draw.choice([1, 1, 3, 6, 12])))
        if self.chance(0.06):
            text = text.replace("<", "<b><", 1) if "<" in text else f"<b>{text}</b>"
        if self.lines == "div":
            return f"<div>{text}</div>"
        if self.lines == "br":
            return f"{text}<br><p>" if self.chance(0.3) else f"<p>{text}</p>"
        if not self.closed:
            return f"<p>{text}"
        return f"<p>{text}</p>" if self.chance(0.93) else f"<p><b>{text}<br>"

    def article(self) -> str:
        d, out = self.draw, []
        if self.chance(0.85):
            out.append(f"<h{d.choice('1112')}>{_MARK}{self.few() if self.chance(0.5) else self.prose(1, 1)}</h1>")
        if self.chance(0.25):
            out.append(d.choice(['<p class="byline">{}</p>', "<div>{}</div>", '<span class="date">{}</span>']).format(_OPEN + self.few() + ", 12 May 2021"))
        many = d.choice([1, 1, 2, 3, 5, 8, 14, 25])
        for k in range(many):
            roll = d.random()
            if roll < 0.8 or many < 3:
                out.append(self.paragraph())
            elif roll < 0.86:
                out.append(f"<h{d.choice('23')}>{_MARK}{self.few()}</h2>")
            elif roll < 0.9:
                tag = d.choice(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(f"<li>{_MARK}{self.few() if self.chance(0.5) else self.prose(1, 2)}</li>" for _ in range(d.randint(2, 6))) + f"</{tag}>")
            elif roll < 0.93:
                out.append(f"<blockquote>{d.choice(['{}', '<p>{}</p>']).format(_MARK + self.prose(1, 3))}</blockquote>")
            elif roll < 0.95:
                out.append(f"<pre>{_MARK}{self.prose(1, 3)}</pre>")
            elif roll < 0.97:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{_MARK}{self.few()}</td>" for _ in range(3)) + "</tr>" for _ in range(d.randint(2, 4))) + "</table>")
            else:
                out.append(f'<figure><img src="/a.png" alt="x"><figcaption>{_OPEN}{self.few()}</figcaption></figure>')
            if self.chance(0.05) and k < many - 1:
                out.append(self.part(d.choice(["ad", "ad", "side", "form", "note"])))
        inner = "".join(out)
        if self.chance(0.15):
            inner = f'<header>{inner.replace("</h1>", "</h1></header>", 1)}' if "</h1>" in inner else inner
        if self.chance(0.2):
            inner += self.part(d.choice(["side", "menu", "ad", "talk"]))
        inner = self.wrap("text", inner)
        for _ in range(d.choice([0, 0, 1, 1, 2])):
            inner = f"<div{self.named('text') if self.chance(0.4) else ''}>{inner}</div>" if self.chance(0.8) else f"<main>{inner}</main>"
        return inner

    def page(self) -> str:
        d = self.draw
        before = [k for k, p in (("note", 0.25), ("head", 0.55), ("menu", 0.75), ("ad", 0.4), ("form", 0.15), ("side", 0.2)) if self.chance(p)]
        after = [k for k, p in (("ad", 0.25), ("side", 0.4), ("talk", 0.4), ("form", 0.25), ("menu", 0.1), ("note", 0.15), ("foot", 0.8)) if self.chance(p)]
        if self.chance(0.5):
            d.shuffle(before)
        head = f"<head><title>{self.few()}</title><style>p{{}}</style><script>var a='<p>';</script></head>" if self.chance(0.8) else ""
        main = self.article() if self.chance(0.97) else ""
        inner = "".join(self.part(k) for k in before) + main + "".join(self.part(k) + ("<!-- x -->" if self.chance(0.1) else "") for k in after)
        if self.chance(0.3):
            inner = f'<div{d.choice(["", " class=container", " id=page", " id=wrapper"])}>{inner}</div>'
        return f"<!DOCTYPE html><html>{head}<body{d.choice(['', ' class=home', ' class=single-post'])}>{inner}</body></html>"


def made_pages(n: int, words: list[str], seed: int = 3) -> list[tuple[Page, np.ndarray]]:
    """Pages and their blocks' labels: 1 of the article, 0 not, -1 either."""
    draw, out = random.Random(seed), []
    while len(out) < n:
        page = Page(Maker(draw, words).page())
        label = np.array([1 if _MARK in t else -1 if _OPEN in t else 0 for t in page.texts])
        page.texts = [t.replace(_MARK, "").replace(_OPEN, "").strip() or "x" for t in page.texts]
        if len(label):
            out.append((page, label))
    return out


_NAMES = {n: features(n, "")[0] for n in "article main nav footer aside form header section".split()}
_PART_OF = {_NAMES[n] for n in ("nav", "footer", "aside", "form")}
_PLAIN_NAMES = {features(n, "")[0] for n in "p h1 h2 h3 b i em strong".split()}


def sure_labels(page: Page) -> np.ndarray:
    """1 of blocks that stand plainly in the page's one article or main, 0 in nav, footer, aside and form, -1 of all others."""
    tops = [k for k, f in enumerate(page.own) if f[0] in (_NAMES["article"], _NAMES["main"])]
    state = []
    for k, f in enumerate(page.own):
        up = state[page.parents[k]] if k else -1
        if f[0] in _PART_OF or up == 0:
            state.append(0)
        elif tops == [k]:
            state.append(1)
        else:
            state.append(1 if up == 1 and len(f) == 1 and f[0] in _PLAIN_NAMES else -1)
    return np.array([state[k] for k in page.at], dtype=np.int64)


# Vectors --------------------------------------------------------------------------------------


class Blocks:
    """What the network reads of some pages' blocks."""

    def __init__(self, pages: list[Page]):
        self.per = np.array([len(p.texts) for p in pages], dtype=np.int64)
        texts = pa.array([t for p in pages for t in p.texts], pa.large_string())
        raw, offsets = W.flat(texts)
        begin, end, self.words = W.spans(raw, offsets, W.ALNUM)
        self.word = (W.word_hashes(raw, begin, end) % np.uint64(WORD_ROWS)).astype(np.int64)
        size = np.diff(offsets).astype(np.float64)
        lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        chars = np.maximum(np.diff(lead[offsets]), 1)

        def share(table: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(table[raw])])
            return np.diff(total[offsets]) / np.maximum(size, 1)

        linked = np.array([x for p in pages for x in p.linked], dtype=np.float64) / chars
        first = np.repeat(np.cumsum(self.per) - self.per, self.per)
        place = np.arange(len(size)) - first
        whole = np.repeat(self.per, self.per)
        last = raw[np.maximum(offsets[1:] - 1, 0)] if len(raw) else np.zeros(0, dtype=np.uint8)
        depth = []
        for p in pages:
            d = [1] * len(p.parents)
            for k in range(1, len(d)):
                d[k] = d[p.parents[k]] + 1
            depth.append(d)
        self.depth = np.array([d[k] for d, p in zip(depth, pages, strict=True) for k in p.at], dtype=np.float64)
        many = np.log1p(self.words)
        self.measures = np.stack([
            np.log1p(chars) / 4, many / 3, chars < 25, chars < 80, linked, linked > 0.9, share(_PUNCT) * 10, np.isin(last, [46, 33, 63]), share(_DIGIT) * 5, share(_UPPER) * 5,
            place / np.maximum(whole, 1), np.log1p(place) / 4, np.log1p(whole - place) / 4, np.log1p(self.depth) / 2,
        ], axis=1).astype(np.float32)
        base = np.concatenate([[0], np.cumsum([len(p.parents) for p in pages])])
        self.element = np.array([b + k for b, p in zip(base, pages, strict=False) for k in p.at], dtype=np.int64)
        self.parent = np.array([b + max(k, 0) for b, p in zip(base, pages, strict=False) for k in p.parents], dtype=np.int64)
        self.root = base[:-1]
        self.own = [f for p in pages for f in p.own]
        self.size = np.array([len(f) for f in self.own], dtype=np.int64)
        self.feature = np.array([x for f in self.own for x in f], dtype=np.int64)

    def elements(self, table: np.ndarray) -> np.ndarray:
        """For each element the mean of its own features' rows."""
        start = np.cumsum(self.size) - self.size
        return np.add.reduceat(table[self.feature], start, axis=0) / self.size[:, None]

    def paths(self, table: np.ndarray) -> np.ndarray:
        """For each block the mean over its element and all elements above it, the rows of an element summed from the root down."""
        total = self.elements(table)
        roots, parent = set(self.root.tolist()), self.parent.tolist()
        for k in range(len(parent)):
            if k not in roots:
                total[k] += total[parent[k]]
        return total[self.element] / self.depth[:, None]

    def said(self, table: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.words), table.shape[1]), dtype=np.float32)
        own = np.flatnonzero(self.words)
        if len(own):
            start = (np.cumsum(self.words) - self.words)[own]
            out[own] = np.add.reduceat(table[self.word], start, axis=0) / self.words[own][:, None]
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """Tables of hashed features, an LSTM in each direction, and a linear end over both states and the block's own vector."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        width = PATH + 2 * INNER + WORD + MEASURES
        self.p = {"path": rng.normal(0, 0.3, (PATH_ROWS, PATH)), "inner": rng.normal(0, 0.3, (PATH_ROWS, INNER)), "word": rng.normal(0, 0.1, (WORD_ROWS, WORD))}
        for d in "fb":
            self.p[f"w{d}"] = rng.normal(0, 1 / np.sqrt(width), (width, 4 * HIDDEN))
            self.p[f"u{d}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
            self.p[f"c{d}"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)  # input, forget, output gates, and the new content
            self.p[f"o{d}"] = rng.normal(0, 0.3, HIDDEN)
        self.p["own"], self.p["bias"] = np.zeros(width), np.zeros(1)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def vectors(self, b: Blocks) -> np.ndarray:
        inner = b.elements(self.p["inner"])
        return np.concatenate([b.paths(self.p["path"]), inner[b.element], inner[b.parent[b.element]], b.said(self.p["word"]), b.measures], axis=1).astype(np.float32)

    def states(self, d: str, x: np.ndarray, mask: np.ndarray, tape: list | None = None) -> np.ndarray:
        """x: time x pages x width; states after each block in reading order of the direction; those past a page's end stay zero."""
        u = self.p[f"u{d}"]
        gates = x @ self.p[f"w{d}"] + self.p[f"c{d}"]
        out = np.zeros((*x.shape[:2], HIDDEN), dtype=np.float32)
        h = c = np.zeros((x.shape[1], HIDDEN), dtype=np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            g = gates[t] + h @ u
            s = _sigmoid(g[:, : 3 * HIDDEN])
            i, f, o, n = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(g[:, 3 * HIDDEN :])
            before_c, before_h = c, h
            c = (f * c + i * n) * mask[t][:, None]
            e = np.tanh(c)
            h = o * e * mask[t][:, None]
            out[t] = h
            if tape is not None:
                tape.append((t, i, f, o, n, before_c, before_h, e))
        return out

    def batch(self, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each block stands, time x pages, and which places hold one."""
        steps = int(per.max()) if len(per) else 0
        at = np.arange(steps)[:, None]
        mask = at < per[None, :]
        return np.where(mask, at + (np.cumsum(per) - per)[None, :], 0), mask

    def scores(self, b: Blocks) -> np.ndarray:
        """The log-odds of each block. Pages of like lengths are read together."""
        own = self.vectors(b)
        out = np.zeros(len(own), dtype=np.float32)
        start = np.cumsum(b.per) - b.per
        order = np.argsort(b.per, kind="stable")
        order = order[b.per[order] > 0]
        low = 0
        while low < len(order):
            high = low + 1
            while high < len(order) and high - low < 256 and b.per[order[high]] <= 1.3 * b.per[order[low]] + 4:
                high += 1
            pages = order[low:high]
            at = np.arange(int(b.per[pages].max()))[:, None]
            mask = at < b.per[pages][None, :]
            place = np.where(mask, at + start[pages][None, :], 0)
            x = own[place] * mask[:, :, None]
            m = mask.astype(np.float32)
            y = self.states("f", x, m) @ self.p["of"] + self.states("b", x, m) @ self.p["ob"] + x @ self.p["own"] + self.p["bias"]
            out[place[mask]] = y[mask]
            low = high
        return out

    def gradients(self, b: Blocks, label: np.ndarray) -> dict[str, np.ndarray]:
        p, own = self.p, self.vectors(b)
        place, mask = self.batch(b.per)
        x, m = own[place] * mask[:, :, None], mask.astype(np.float32)
        tapes: dict[str, list] = {"f": [], "b": []}
        states = {d: self.states(d, x, m, tapes[d]) for d in "fb"}
        y = states["f"] @ p["of"] + states["b"] @ p["ob"] + x @ p["own"] + p["bias"]
        want = np.where(mask, label[place], -1)
        error = np.where(want >= 0, _sigmoid(y) - want, 0).astype(np.float32) / max(1, int((want >= 0).sum()))
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        grad["bias"][:] = error.sum()
        grad["own"] = np.einsum("tp,tpw->w", error, x)
        dx = error[:, :, None] * p["own"]
        for d in "fb":
            grad[f"o{d}"] = np.einsum("tp,tph->h", error, states[d])
            u, flow, flow_c = p[f"u{d}"], np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32)
            back = np.zeros((*x.shape[:2], 4 * HIDDEN), dtype=np.float32)
            for t, i, f, o, n, before_c, before_h, e in reversed(tapes[d]):
                dh = (flow + error[t][:, None] * p[f"o{d}"]) * m[t][:, None]
                dc = flow_c * m[t][:, None] + dh * o * (1 - e * e)
                g = np.concatenate([dc * n * i * (1 - i), dc * before_c * f * (1 - f), dh * e * o * (1 - o), dc * i * (1 - n * n)], axis=1) * m[t][:, None]
                back[t] = g
                grad[f"u{d}"] += before_h.T @ g
                flow, flow_c = g @ u.T, dc * f
            grad[f"w{d}"] = np.einsum("tpw,tpg->wg", x, back, optimize=True)
            grad[f"c{d}"] = back.sum(axis=(0, 1))
            dx += back @ p[f"w{d}"].T
        flat = np.zeros_like(own)
        flat[place[mask]] = dx[mask]
        self._into_tables(b, flat, grad)
        return grad

    def _into_tables(self, b: Blocks, flat: np.ndarray, grad: dict[str, np.ndarray]) -> None:
        path, one, two, word = np.split(flat[:, : PATH + 2 * INNER + WORD], [PATH, PATH + INNER, PATH + 2 * INNER], axis=1)
        total = np.zeros((len(b.parent), PATH), dtype=np.float32)
        np.add.at(total, b.element, path / b.depth[:, None].astype(np.float32))
        for k in range(len(total) - 1, -1, -1):  # what reached an element reaches those above it
            if b.parent[k] != k:
                total[b.parent[k]] += total[k]
        inner = np.zeros((len(b.parent), INNER), dtype=np.float32)
        np.add.at(inner, b.element, one)
        np.add.at(inner, b.parent[b.element], two)
        size = b.size[:, None].astype(np.float32)
        np.add.at(grad["path"], b.feature, np.repeat(total / size, b.size, axis=0))
        np.add.at(grad["inner"], b.feature, np.repeat(inner / size, b.size, axis=0))
        np.add.at(grad["word"], b.word, np.repeat(word / np.maximum(b.words, 1)[:, None].astype(np.float32), b.words, axis=0))

    def train(self, pages: list[tuple[Page, np.ndarray]], steps: int = STEPS, rate: float = 0.02, seed: int = 9) -> None:
        """Adam over random batches of pages of like lengths."""
        rng = np.random.default_rng(seed)
        pages = sorted(pages, key=lambda x: len(x[1]))
        sets = []
        for k in range(0, len(pages), BATCH):
            some = pages[k : k + BATCH]
            sets.append((Blocks([p for p, _ in some]), np.concatenate([y for _, y in some])))
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            b, label = sets[rng.integers(len(sets))]
            g = self.gradients(b, label)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            now = rate * min(1.0, 3.0 * (1 - step / (steps + 1)) + 0.02)
            for k, v in g.items():
                v = v * min(1.0, 1.0 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                self.p[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)


# Pages ----------------------------------------------------------------------------------------

_PLAIN = "the of and to in a is that for it was on with as by at from this have or one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know der die und das nicht ist ein eine le la les des est une que pour dans el los que una por con para".split()


def _trained(htmls: list[str], made: int, steps: int):
    """The network's arrays, one a row. It is trained in a task, where numpy keeps to the task's own core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words, known = list(_PLAIN), []
            for html in htmls:
                page = Page(html)
                for text in page.texts:
                    words += [w for w in text.split()[:200] if "<" not in w and "&" not in w]
                label = sure_labels(page)
                if (label == 1).any():
                    known.append((page, label))
            net = Network()
            net.train(made_pages(made, words) + KNOWN_TIMES * known, steps)
            names = list(net.p)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([net.p[n].tobytes() for n in names], pa.binary())], names=["name", "data"])

    return run


def fit(spark: SparkSession, pages: DataFrame | None, made: int = MADE, steps: int = STEPS) -> Network:
    """Trains on made pages, and on the sure labels of SAMPLE_PAGES of the given pages, the first by a hash of page_id and url;
    of a sampled page up to 65,536 code points."""
    htmls = []
    if pages is not None:
        drawn, many = F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 40)), max(1, pages.count())
        some = pages.where("html is not null").select(drawn.alias("drawn"), F.substring("html", 1, 1 << 16).alias("html"))
        some = some.where(F.col("drawn") < (2 * SAMPLE_PAGES << 40) // many)  # twice as many as needed come to the driver
        htmls = [r["html"] for r in some.orderBy("drawn", "html").limit(SAMPLE_PAGES).collect()]
    net = Network()
    for r in spark.range(1, numPartitions=1).mapInArrow(_trained(htmls, made, steps), "name string, data binary").collect():
        net.p[r["name"]] = np.frombuffer(bytes(r["data"]), dtype=np.float32).reshape(net.p[r["name"]].shape)
    return net


def main_texts(net: Network, htmls: list[str | None]) -> list[str]:
    """The article's blocks of each page, in page order."""
    pages = [Page(h or "") for h in htmls]
    score = net.scores(Blocks(pages)) if any(p.texts for p in pages) else []
    out, at = [], 0
    for p in pages:
        out.append("\n\n".join(t for t, s in zip(p.texts, score[at : at + len(p.texts)], strict=True) if s > 0))
        at += len(p.texts)
    return out


def extract(pages: DataFrame, net: Network, carry: list[str]) -> DataFrame:
    """The carried columns, text and n_chars, its code points."""
    source = pages.select(F.struct(*carry).alias("row"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "html"):
                texts = main_texts(net, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["row", "text", "n_chars"])

    kinds = f"row {source.schema['row'].dataType.simpleString()}, text string, n_chars long"
    return W.small_batches(source).mapInArrow(run, kinds).select("row.*", "text", "n_chars")


def op13_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, fit(spark, pages), ["page_id", "url"])
