"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is read into leaf blocks: runs of text between block-level tags, each with what its ancestors
are (tags, class and id words, roles) and how its text looks. A chain of two labels, text or
boilerplate, is decoded over them by Viterbi. The weights are trained on labelled pages that are
generated here from a seed (``generate_page``): layouts with and without semantic tags, menus,
notices, adverts inside articles, forms, sidebars, reader comments, so that structure decides and
not the length of a text.

Scripts, styles, comments, titles and other parts that never show text are left out when the page is
read. The head needs no closing tag: what it may hold is left out by itself, and what shows text ends it,
as in parsers. Whole pages are read; null counts as the empty page, whose text is empty. Pages are
independent, so ties, repeated rows and other columns need no rule; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, texts_of

#: Elements that break a line of text.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre search section select summary table tbody "
    "td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag closes these if they stand open inside the nearest of the containers.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr"}),
    "th": ({"td", "th"}, {"tr"}),
    "option": ({"option"}, {"select"}),
}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title)(?=[\s/>])[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<unseen>noscript|template|svg(?![^>]*/>)|iframe|canvas|annotation-xml|annotation)(?=[\s/>])[^>]*+>"
    r"|<[!?][^>]*+>"
    r"""|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?>[^>"']|"[^"]*+"|'[^']*+')*+)>"""
    r"|</?[a-zA-Z][^>]*+(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
#: The ends of elements whose content is not shown; one that is never closed hides nothing.
_UNSEEN_END = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in "noscript template svg iframe canvas annotation-xml annotation".split()}
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-[a-z]+|type)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)

#: Ancestor features: tags, then words of class, id and role.
TAGS = ("nav", "header", "footer", "aside", "form", "article", "main", "section", "list", "table", "figure", "control", "blockquote", "dialog")
_TAG_OF = {t: t for t in TAGS} | dict.fromkeys(("ul", "ol", "menu", "dl"), "list") | dict.fromkeys(("button", "label", "select", "fieldset"), "control")
WORDS = {
    "advert": r"\bad\b|\bads\b|advert|sponsor|promo|banner-?ad|adsense|\bad-|-ad\b|adslot|ad-?box",
    "menu": r"nav|menu|breadcrumb|crumb|pagination|pager|\btabs?\b|toolbar|navigation",
    "comments": r"comment|disqus|discussion|\breply|replies|respond|reader",
    "notice": r"cookie|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|paywall|banner|dialog",
    "side": r"sidebar|\bside\b|side-?bar|aside|widget|related|recommend|trending|popular|more-stories|complementary|\brail\b",
    "social": r"social|share|follow|tweet|facebook",
    "frame": r"footer|\bfoot\b|header|masthead|copyright|legal|contentinfo|topbar|site-?info|colophon",
    "meta": r"byline|author|\bmeta\b|\bdate\b|timestamp|\btags?\b|categories",
    "form": r"login|signin|sign-up|signup|search|contact-form|\bform\b|\binput\b",
    "content": r"content|article|\bpost\b|entry|story|\btext\b|\bbody\b|\bmain\b|prose|page-?body",
    "hidden": r"hidden|display:\s*none|visually|sr-only",
}
_WORD_OF = {k: re.compile(v) for k, v in WORDS.items()}
OWN = ("p", "h1", "heading", "li", "div", "cell", "pre", "other")
#: Words that notices, menus and footers use, in some languages.
_PHRASES = re.compile(
    r"cookie|copyright|©|all rights reserved|subscri|newsletter|sign (?:in|up)|log ?in|privacy|terms of|advert|sponsor|share this|read more|"
    r"datenschutz|impressum|anmelden|mentions légales|connexion|iniciar sesión|aviso legal",
    re.IGNORECASE,
)
TEXT = ("links", "all_links", "few", "some", "many", "log_words", "ends", "commas", "phrase", "first", "last", "bias")
NAMES = (*(f"in_{t}" for t in TAGS), *(f"word_{w}" for w in WORDS), *(f"own_{o}" for o in OWN), *TEXT)
_TAG_BIT = {t: 1 << i for i, t in enumerate(TAGS)}
_WORD_BIT = {w: 1 << (len(TAGS) + i) for i, w in enumerate(WORDS)}
_ANCESTORS = len(TAGS) + len(WORDS)
_BITS = np.arange(_ANCESTORS)


@dataclass
class Block:
    text: str
    ancestors: int
    own: str
    link_chars: int


@functools.lru_cache(maxsize=8192)
def _bits(tag: str, attrs: str) -> int:
    out = _TAG_BIT.get(_TAG_OF.get(tag, ""), 0)
    if attrs:
        said = []
        for name, *values in _ATTRIBUTE.findall(attrs):
            name = name.lower()
            value = next((v for v in values if v), "").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true":
                out |= _WORD_BIT["hidden"]
            elif name in ("class", "id", "role", "style"):
                said.append(value if name != "role" else {"banner": "header"}.get(value, value))
        words = " ".join(said).replace("_", "-")
        for word, rule in _WORD_OF.items():
            if words and rule.search(words):
                out |= _WORD_BIT[word]
    return out


def _own(tag: str) -> str:
    if tag in ("p", "h1", "li", "div", "pre"):
        return tag
    if tag in ("h2", "h3", "h4", "h5", "h6"):
        return "heading"
    return "cell" if tag in ("td", "th", "dd", "dt") else "other"


def leaf_blocks(page: str) -> list[Block]:
    """The runs of text between block-level tags, white space collapsed, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = [("", 0)]
    held: list[str] = []
    link = {"open": False, "chars": 0}

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append(Block(text, stack[-1][1], _own(stack[-1][0]), min(link["chars"], len(text))))
            held.clear()
        link["chars"] = 0

    def words(raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            held.append(text)
            if link["open"]:
                link["chars"] += len(text.strip())

    def close(tags: set[str], until: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in until:
                return
            if stack[k][0] in tags:
                del stack[k:]
                return

    at = 0
    endless: set[str] = set()
    while m := _TOKEN.search(page, at):
        words(page[at : m.start()])
        at = m.end()
        if (unseen := (m["unseen"] or "").lower()) and unseen not in endless:
            if end := _UNSEEN_END[unseen].search(page, at):
                at = end.end()
            else:
                endless.add(unseen)
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            link["open"] = not m["close"]
        elif tag == "br":
            held.append(" ")
        if tag not in BLOCKS:
            continue
        flush()
        link["open"] = False
        if m["close"]:
            close({tag}, set())
            continue
        close({"p"}, {"td", "th", "li", "div", "article", "section", "blockquote", "body"} - {"p"})
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag not in VOID:
            stack.append((tag, stack[-1][1] | _bits(tag, m["attrs"])))
    words(page[at:])
    flush()
    return out


def features(blocks: list[Block]) -> np.ndarray:
    """One row of ``NAMES`` for each block."""
    n = len(blocks)
    out = np.zeros((n, len(NAMES)))
    masks = np.fromiter((b.ancestors for b in blocks), np.int64, n)
    out[:, :_ANCESTORS] = masks[:, None] >> _BITS & 1
    own = _ANCESTORS + np.fromiter((OWN.index(b.own) for b in blocks), np.int64, n)
    out[np.arange(n), own] = 1
    base = _ANCESTORS + len(OWN)
    for i, b in enumerate(blocks):
        text = b.text
        count = text.count(" ") + 1
        links = b.link_chars / len(text)
        out[i, base:] = (
            links, links > 0.8, count <= 3, 3 < count <= 12, count > 40, math.log1p(count) / 5, text[-1] in ".!?…\"”", min(text.count(","), 5) / 5,
            bool(_PHRASES.search(text)), i == 0, i == n - 1, 1.0,
        )
    return out


@dataclass
class Chain:
    """Weights of the label "text" over "boilerplate", of each pair of neighbouring labels, and of the first."""

    weights: np.ndarray
    moves: np.ndarray
    first: np.ndarray

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The likeliest labels (Viterbi)."""
        n = len(x)
        if not n:
            return np.zeros(0, bool)
        gain = (x @ self.weights).tolist()
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b = self.first[0], self.first[1] + gain[0]
        back = []
        for g in gain[1:]:
            from_a, from_b = a + m00 >= b + m10, a + m01 > b + m11
            back.append((0 if from_a else 1, 0 if from_b else 1))
            a, b = max(a + m00, b + m10), max(a + m01, b + m11) + g
        label = int(b > a)
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return np.array(labels[::-1], bool)


def fit(pages: list[tuple[np.ndarray, np.ndarray]], *, steps: int = 250, rate: float = 0.15, ridge: float = 1e-5) -> Chain:
    """Maximise the conditional likelihood; all pages go through forward-backward together."""
    pages = [p for p in pages if len(p[1])]
    count, most, wide = len(pages), max(len(y) for _, y in pages), pages[0][0].shape[1]
    x, y, here = np.zeros((count, most, wide)), np.zeros((count, most), np.int64), np.zeros((count, most), bool)
    for i, (f, labels) in enumerate(pages):
        x[i, : len(labels)], y[i, : len(labels)], here[i, : len(labels)] = f, labels, True
    both = here[:, 1:]
    theta = np.zeros(wide + 6)
    moment, square = np.zeros_like(theta), np.zeros_like(theta)
    total = here.sum()
    seen_moves = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            seen_moves[a, b] = ((y[:, :-1] == a) & (y[:, 1:] == b) & both).sum()
    seen_first = np.bincount(y[:, 0], minlength=2)
    seen_weights = np.einsum("itk,it->k", x, (y * here).astype(float))
    for step in range(1, steps + 1):
        w, moves, first = theta[:wide], theta[wide : wide + 4].reshape(2, 2), theta[wide + 4 :]
        unary = np.stack([np.zeros((count, most)), x @ w], axis=2)
        alpha, beta = np.zeros((most, count, 2)), np.zeros((most, count, 2))
        alpha[0] = first + unary[:, 0]
        for t in range(1, most):
            into = np.logaddexp(alpha[t - 1][:, :1] + moves[0], alpha[t - 1][:, 1:] + moves[1]) + unary[:, t]
            alpha[t] = np.where(here[:, t, None], into, alpha[t - 1])
        norm = np.logaddexp(alpha[-1][:, 0], alpha[-1][:, 1])
        for t in range(most - 2, -1, -1):
            out = beta[t + 1] + unary[:, t + 1]
            back = np.logaddexp(moves[:, 0] + out[:, :1], moves[:, 1] + out[:, 1:])
            beta[t] = np.where(here[:, t + 1, None], back, 0)
        p = np.exp(alpha.transpose(1, 0, 2) + beta.transpose(1, 0, 2) - norm[:, None, None]) * here[:, :, None]
        grad = np.zeros_like(theta)
        grad[:wide] = seen_weights - np.einsum("itk,it->k", x, p[:, :, 1])
        for a in (0, 1):
            for b in (0, 1):
                pair = np.exp(alpha[:-1, :, a] + moves[a, b] + unary[:, 1:, b].T + beta[1:, :, b] - norm) * both.T
                grad[wide + 2 * a + b] = seen_moves[a, b] - pair.sum()
        grad[wide + 4 :] = seen_first - p[:, 0].sum(axis=0)
        grad = grad / total - ridge * theta
        moment = 0.9 * moment + 0.1 * grad
        square = 0.999 * square + 0.001 * grad**2
        theta = theta + rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Chain(theta[:wide], theta[wide : wide + 4].reshape(2, 2), theta[wide + 4 :])


class _Writer:
    """Writes a random page and knows which of its texts are the article."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.labels: list[tuple[str, bool]] = []
        self.count = 0

    def words(self, least: int, most: int) -> str:
        n = self.r.randint(least, most)
        made = ["".join(self.r.choice("ba ne ti or sh el un ka mi so the re".split()) for _ in range(self.r.randint(1, 4))) for _ in range(n)]
        text = " ".join(w + ("," if self.r.random() < 0.07 else "") for w in made).capitalize()
        return text + (self.r.choice(".!?") if self.r.random() < 0.75 else "")

    def put(self, tag: str, main: bool, least: int = 1, most: int = 60, *, attrs: str = "", text: str = "") -> str:
        """A leaf whose text is unlike any other on the page."""
        self.count += 1
        text = f"{text or self.words(least, most)} k{self.count}"
        self.labels.append((text, main))
        if self.r.random() < 0.2 and " " in text:
            a, b = text.split(" ", 1)
            return f"<{tag}{attrs}><b>{a}</b> {b}</{tag}>"
        if not main and self.r.random() < 0.2:
            return f'<{tag}{attrs}><a href="#">{text}</a></{tag}>'
        return f"<{tag}{attrs}>{text}</{tag}>"

    def links(self, n: int) -> str:
        return "<ul>" + "".join(self.put("li", False, 1, 3) if self.r.random() < 0.3 else self._link() for _ in range(n)) + "</ul>"

    def _link(self) -> str:
        self.count += 1
        text = f"{self.words(1, 3)} k{self.count}"
        self.labels.append((text, False))
        return f'<li><a href="/x">{text}</a></li>'

    def named(self, semantic: str, names: list[str], inner: str, *, plain: bool) -> str:
        if not plain and self.r.random() < 0.6:
            return f"<{semantic}>{inner}</{semantic}>"
        return f'<div {self.r.choice(["class", "id"])}="{self.r.choice(names)}">{inner}</div>'


def _bare_page(seed: int) -> tuple[str, list[tuple[str, bool]]]:
    """A page of text blocks alone, some without any element around them."""
    w = _Writer(seed)
    inner = "".join(w.put(w.r.choice(["p", "p", "p", "h1", "div"]), True, 1, w.r.choice([12, 80, 400])) for _ in range(w.r.choice([1, 1, 2, 6])))
    if w.r.random() < 0.35:
        inner = w.words(2, w.r.choice([12, 80, 400])) + " k1"
        w.labels = [(inner, True)]
    return w.r.choice(["%s", "<body>%s</body>", "<html><head><title>t</title></head><body>%s</body></html>"]) % inner, w.labels


def generate_page(seed: int) -> tuple[str, list[tuple[str, bool]]]:
    """A labelled page: its html, and each leaf's text with whether it is the article's, in page order; one in twelve is bare."""
    if seed % 12 == 5:
        return _bare_page(seed)
    w = _Writer(seed)
    r = w.r
    plain = r.random() < 0.35
    parts = []
    if r.random() < 0.4:
        notice = "<div class=\"%s\">" % r.choice(["cookie-notice", "consent", "gdpr-banner", "alert", "notice", "newsletter-popup"])
        parts.append(notice + w.put("p", False, 3, 40, text=r.choice(["", "", "We use cookies to improve this site"])) + w.put("button", False, 1, 2) + "</div>")
    if r.random() < 0.6:
        parts.append(w.named("header", ["header", "masthead", "topbar", "site-header"], w.put(r.choice(["div", "p", "h1", "span"]) if r.random() < 0.5 else "div", False, 1, 10), plain=plain))
    if r.random() < 0.8:
        parts.append(w.named("nav", ["nav", "menu", "navbar", "main-menu", "breadcrumbs"], w.links(r.randint(2, 9)), plain=plain))
    if r.random() < 0.5:
        parts.append(f'<div class="{r.choice(["ad", "ads", "advert", "sponsored", "ad-box", "promo"])}">' + w.put(r.choice(["p", "div"]), False, 1, 50) + "</div>")
    if r.random() < 0.25:
        parts.append("<form>" + w.put("label", False, 1, 4) + '<input type="text">' + w.put("button", False, 1, 2) + "</form>")
    side = w.named("aside", ["sidebar", "side", "widget", "related", "trending"], w.put("h3", False, 1, 4) + w.links(r.randint(1, 5)) + (w.put("p", False, 1, 60) if r.random() < 0.5 else ""), plain=plain) if r.random() < 0.25 else ""
    body = [w.put(r.choice(["h1", "h1", "h1", "h2"]), True, 1, 15)] if r.random() < 0.9 else []
    for _ in range(r.randint(1, 12)):
        kind = r.random()
        if kind < 0.72:
            body.append(w.put("p", True, 1, r.choice([3, 12, 80, 150])))
        elif kind < 0.79:
            body.append(w.put(r.choice(["h2", "h3"]), True, 1, 8))
        elif kind < 0.85:
            tag = r.choice(["ul", "ol"])
            body.append(f"<{tag}>" + "".join(w.put("li", True, 1, 25) for _ in range(r.randint(1, 5))) + f"</{tag}>")
        elif kind < 0.88:
            body.append("<blockquote>" + w.put("p", True, 1, 40) + "</blockquote>")
        elif kind < 0.9:
            body.append("<table><tr>" + "".join(w.put("td", True, 1, 5) for _ in range(r.randint(1, 4))) + "</tr></table>")
        elif kind < 0.94:
            body.append(f'<div class="{r.choice(["ad", "advert", "ad-slot", "promo", "sponsor"])}">' + w.put(r.choice(["p", "div"]), False, 1, 40) + "</div>")
        elif kind < 0.97:
            body.append(f'<div class="{r.choice(["share", "social", "newsletter", "related", "subscribe"])}">' + w.put("p", False, 1, 12) + "</div>")
        else:
            body.append("<aside>" + w.put("p", False, 1, 40) + "</aside>")
    inner = "".join(body)
    if plain:
        article = f'<div{r.choice(["", "", " class=\"content\"", " id=\"main\"", " class=\"post-body\""])}>{inner}</div>'
    else:
        article = r.choice(["<article>%s</article>", "<article>%s</article>", "<main>%s</main>", "<main><article>%s</article></main>", '<div class="content">%s</div>', '<section class="story">%s</section>', '<div role="main">%s</div>']) % inner
    parts.append(article)
    if r.random() < 0.35:
        said = "".join(f'<div class="comment">{w.put("p", False, 1, 60)}</div>' if r.random() < 0.6 else f"<li>{w.put('p', False, 1, 60)}</li>" for _ in range(r.randint(1, 5)))
        parts.append(f'<{"section" if r.random() < 0.5 else "div"} {r.choice(["id", "class"])}="{r.choice(["comments", "comment-list", "discussion", "disqus", "reader-comments", "replies"])}">' + w.put("h3", False, 1, 4) + said + "</div>")
    parts.append(side)
    if r.random() < 0.85:
        parts.append(w.named("footer", ["footer", "site-footer", "copyright", "legal"], w.put(r.choice(["p", "div", "div"]), False, 1, 30, text=r.choice(["", "© site · ", "All rights reserved"])) + (w.links(r.randint(1, 4)) if r.random() < 0.4 else ""), plain=plain))
    return "<html><head><title>t</title></head><body>" + "".join(parts) + ("</body></html>" if r.random() < 0.9 else ""), w.labels


def labelled(seed: int) -> tuple[np.ndarray, np.ndarray]:
    page, labels = generate_page(seed)
    main = {text.split()[-1]: is_main for text, is_main in labels}
    blocks = leaf_blocks(page)
    return features(blocks), np.array([main.get(b.text.split()[-1], False) for b in blocks], np.int64)


@functools.lru_cache(maxsize=2)
def trained(pages: int = 540) -> Chain:
    """The chain fitted on the generated pages 0 to ``pages`` - 1; some seconds, once per driver."""
    return fit([labelled(seed) for seed in range(pages)])


def page_text(page: str, chain: Chain) -> str:
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, keep in zip(blocks, chain.decode(features(blocks)), strict=True) if keep)


def extract(pages: DataFrame, chain: Chain | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and the main text of each page. One narrow pass."""
    model = chain or trained()
    types = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "html"):
            made = [page_text(p, model) for p in texts_of(part, "html")]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(made, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"page_id {types[id_col]}, url {types[url_col]}, text string")
