"""Main-text extraction from HTML: a linear-chain conditional random field over DOM leaf blocks.

A small DOM reader (open-element stack, raw-text elements, character references, optional end tags) cuts a page into leaf
blocks: runs of text that no block-level tag interrupts. Tags are read as browsers read them (quotes count only where a
value begins), and the sets of open tags and names are kept up as elements open and close, so time is linear in a page's
length however deep it nests. Each block gets binary features from its ancestor tags, their class and id words, its text
(length, link share, end sign, ...), and the share of the page's running text in the elements that hold it. A two-label CRF (main text or not), trained by
gradient ascent on the log-likelihood of labelled pages, scores label sequences; Viterbi finds the best one. The blocks
labelled main text are the result, in page order.

Labelled pages come from `labelled_pages`, a seeded generator of page layouts whose blocks are labelled as they are
written; a caller can pass its own. Weights are a few hundred numbers, so each task gets them with its code.

Defined cases: a null or empty page has empty text; tags cut off at the end of a page are dropped, text before them is
kept; white space inside a block becomes one space; blocks without text don't count; repeated rows are extracted each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li link main menu meta nav object ol optgroup option p pre section select"
    " summary table tbody td template textarea tfoot th thead title tr ul video audio canvas xmp".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript iframe noembed noframes svg template".split())
#: Elements whose content is text without tags.
TEXT_TAGS = frozenset(("title", "textarea", "xmp"))
#: A new tag of the key closes an open one of the value, up to the nearest container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CONTAINERS = frozenset("article aside body div dl footer form header html main nav ol section table tbody ul".split())
_P_CLOSERS = BLOCK_TAGS - {"button", "label", "option", "legend", "iframe", "object", "template", "link", "meta", "title", "head", "html", "body", "li"}
#: Attributes: a name, and after "=" a value in quotes or one that ends at white space or ">". Atomic, so it never goes back.
_ATTRIBUTES = r"""(?>(?:[\s/]+|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+|(?=>)|\Z))?+)*+)"""
_TAG = re.compile(rf"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|/(?:>|[^a-zA-Z>][^>]*(?:>|\Z))|(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})(>|\Z))", re.S)
_NAMES = re.compile(r"""(?:^|[\s/"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_P, _NONE = frozenset(("p",)), frozenset()

#: Words in class and id names that speak against or for main text.
NOISE_NAMES = frozenset(
    "ad ads advert advertisement adsense banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies copyright disclaimer disqus"
    " footer form gdpr header login masthead menu meta modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted"
    " recommend recommended related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe tags teaser toolbar widget".split()
)
MAIN_NAMES = frozenset("article articlebody body content entry main post story text".split())


_TOLD = NOISE_NAMES | MAIN_NAMES


class Block:
    """A run of text, its innermost element, all its elements' tags and telling names, the characters in links, and the
    numbers of the two innermost containers that hold it."""

    __slots__ = ("holders", "link_chars", "names", "own", "tags", "text")

    def __init__(self, text: str, own: str, tags: frozenset[str], names: frozenset[str], link_chars: int, holders: tuple[int, int]):
        self.text, self.own, self.tags, self.names, self.link_chars, self.holders = text, own, tags, names, link_chars, holders


class _Open:
    """The open block elements. Every question costs the same at any depth."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, frozenset[str]]] = []
        self.at: dict[str, list[int]] = {}
        self.names: dict[str, int] = {}
        self.containers: list[tuple[int, int]] = []
        self.opened = 0
        self._sets: tuple[frozenset[str], frozenset[str]] | None = None

    def push(self, tag: str, names: frozenset[str]) -> None:
        self.opened += 1
        self.at.setdefault(tag, []).append(len(self.stack))
        if tag in _CONTAINERS:
            self.containers.append((len(self.stack), self.opened))
        self.stack.append((tag, names))
        for x in names:
            self.names[x] = self.names.get(x, 0) + 1
        self._sets = None

    def close(self, tag: str) -> None:
        if places := self.at.get(tag):
            self._cut(places[-1])

    def close_within(self, tags: frozenset[str] | set[str]) -> None:
        """Closes the innermost open element of the tags, unless a container inside it is open."""
        place = max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)
        if place >= 0 and (not self.containers or place >= self.containers[-1][0]):
            self._cut(place)

    def _cut(self, place: int) -> None:
        while len(self.stack) > place:
            tag, names = self.stack.pop()
            self.at[tag].pop()
            if tag in _CONTAINERS:
                self.containers.pop()
            for x in names:
                self.names[x] -= 1
        self._sets = None

    def sets(self) -> tuple[frozenset[str], frozenset[str]]:
        if self._sets is None:
            self._sets = frozenset(t for t, places in self.at.items() if places), frozenset(x for x, n in self.names.items() if n)
        return self._sets

    def block(self, text: str, links: int) -> Block:
        held = [number for _, number in self.containers[-2:]]
        return Block(text, self.stack[-1][0] if self.stack else "-", *self.sets(), links, tuple([0, 0, *held][-2:]))


def leaf_blocks(page: str) -> list[Block]:
    """The page's runs of text with what is known of the elements around them."""
    out: list[Block] = []
    open_ = _Open()
    parts: list[str] = []
    links = at = 0
    in_link = 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(open_.block(text, links))
            parts.clear()
        links = 0

    def add(raw: str) -> None:
        nonlocal links
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                links += len(text.strip())

    n = len(page)
    while at < n:
        cut = page.find("<", at)
        if cut < 0:
            add(page[at:])
            break
        m = _TAG.match(page, cut)
        if m is None:  # a bare "<" is text
            add(page[at : cut + 1])
            at = cut + 1
            continue
        add(page[at:cut])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(m[1])
        if not m[4]:  # the page ends inside this tag
            break
        if tag in RAW_TAGS:
            if not closing and not m[3].endswith("/"):
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        block = tag in BLOCK_TAGS
        if block:
            flush()
        elif tag == "br":
            parts.append("\n")
        elif tag == "a":
            in_link = 0 if closing else 1
        if not block or tag in VOID_TAGS:
            continue
        if closing:
            open_.close(tag)
            continue
        if tag in _P_CLOSERS:
            open_.close_within(_P)
        if tag in CLOSES:
            open_.close_within(CLOSES[tag])
        names = _NAMES.findall(m[3]) if m[3] else ()
        open_.push(tag, frozenset(_WORD.findall(" ".join(a or b or c for a, b, c in names).lower())) & _TOLD if names else _NONE)
        if tag in TEXT_TAGS:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            add(page[at : end.start() if end else n])
            flush()
            open_.close(tag)
            at = end.end() if end else n
    flush()
    return out


def block_features(blocks: list[Block]) -> list[list[str]]:
    sizes = [b.text.count(" ") + 1 for b in blocks]
    held: tuple[dict[int, int], dict[int, int]] = ({}, {})
    for b, words in zip(blocks, sizes, strict=True):
        if words >= 5 and 2 * b.link_chars < len(b.text) and not b.names & NOISE_NAMES:
            for level, number in zip(held, b.holders, strict=True):
                level[number] = level.get(number, 0) + words
    most = [max(level.values(), default=1) for level in held]
    out = []
    for i, b in enumerate(blocks):
        f = ["bias", f"own:{b.own}", f"words:{min(7, int(math.log2(sizes[i])))}", f"end:{b.text[-1] in '.!?…:;'}", f"links:{min(4, 4 * b.link_chars // max(1, len(b.text)))}"]
        f += [f"holder{k}:{4 * level.get(number, 0) // m}" for k, (level, number, m) in enumerate(zip(held, b.holders, most, strict=True))]
        f += [f"in:{t}" for t in b.tags]
        noise, main = b.names & NOISE_NAMES, b.names & MAIN_NAMES
        if noise:
            f.append("name:noise")
        if main:
            f.append("name:main")
        f += [f"name:{x}" for x in noise | main]
        if "©" in b.text or "opyright" in b.text:
            f.append("text:copyright")
        if sum(c.isdigit() for c in b.text) * 3 > len(b.text):
            f.append("text:digits")
        out.append(f)
    return out


class LinearChainCrf:
    """Two labels. score(y) = sum of the weights of each block's features for its label + transitions."""

    def __init__(self, weights: dict[str, tuple[float, float]] | None = None, step: np.ndarray | None = None):
        self.weights = weights or {}
        self.step = np.zeros((2, 2)) if step is None else step

    def unary(self, features: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(features), 2))
        for i, fs in enumerate(features):
            for f in fs:
                w = self.weights.get(f)
                if w is not None:
                    out[i, 0] += w[0]
                    out[i, 1] += w[1]
        return out

    def viterbi(self, u: np.ndarray) -> list[int]:
        (s00, s01), (s10, s11) = self.step.tolist()
        back, (a, b) = [], u[0].tolist()
        for x, y in u[1:].tolist():
            from0, from1 = a + s00 < b + s10, a + s01 < b + s11
            back.append((from0, from1))
            a, b = (b + s10 if from0 else a + s00) + x, (b + s11 if from1 else a + s01) + y
        label = int(b > a)
        labels = [label]
        for pair in reversed(back):
            label = int(pair[label])
            labels.append(label)
        return labels[::-1]

    def expected(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of labels, and expected transitions (forward-backward in logarithms)."""
        n = len(u)
        alpha, beta = u.copy(), np.zeros((n, 2))
        for i in range(1, n):
            alpha[i] += np.logaddexp(alpha[i - 1, 0] + self.step[0], alpha[i - 1, 1] + self.step[1])
        for i in range(n - 2, -1, -1):
            x = u[i + 1] + beta[i + 1]
            beta[i] = np.logaddexp(self.step[:, 0] + x[0], self.step[:, 1] + x[1])
        z = np.logaddexp(*alpha[-1])
        pairs = np.zeros((2, 2))
        for i in range(1, n):
            pairs += np.exp(alpha[i - 1][:, None] + self.step + (u[i] + beta[i])[None, :] - z)
        return np.exp(alpha + beta - z), pairs

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], rounds: int = 6, rate: float = 0.3, ridge: float = 1e-3) -> LinearChainCrf:
        """Adagrad on the penalised log-likelihood, one page at a time."""
        names = {f: i for i, f in enumerate(sorted({f for fs, _ in pages for block in fs for f in block}))}
        w, g2 = np.zeros((len(names), 2)), np.full((len(names), 2), 1e-6)
        s2 = np.full((2, 2), 1e-6)
        coded = [([np.array([names[f] for f in block]) for block in fs], ys) for fs, ys in pages if fs]
        order = random.Random(7)
        for _ in range(rounds):
            order.shuffle(coded)
            for fs, ys in coded:
                u = np.array([w[ix].sum(axis=0) for ix in fs])
                p, pairs = self.expected(u)
                truth = np.eye(2)[ys]
                flat = np.concatenate(fs)
                grad = np.zeros_like(w)
                np.add.at(grad, flat, np.repeat(truth - p, [len(ix) for ix in fs], axis=0))
                used = np.unique(flat)
                gu = grad[used] - ridge * w[used]
                g2[used] += gu**2
                w[used] += rate * gu / np.sqrt(g2[used])
                seen = np.zeros((2, 2))
                np.add.at(seen, (ys[:-1], ys[1:]), 1)
                gs = seen - pairs - ridge * self.step
                s2 += gs**2
                self.step = self.step + rate * gs / np.sqrt(s2)
        self.weights = {f: (float(w[i, 0]), float(w[i, 1])) for f, i in names.items()}
        return self


def labelled_pages(count: int = 420, seed: int = 11) -> list[tuple[list[list[str]], list[int]]]:
    """Seeded page layouts, with and without telling tags and names; main-text blocks are marked while they are written, and
    the marks are read back as labels."""
    r = random.Random(seed)
    mark = "†"  # stands in a main-text block while a page is built
    syllables = "an ber co da el fi gu ha in jo ka le mi no or pa qui re sa ti un ver wo xi ya zo".split()

    def words(low: int, high: int) -> str:
        return " ".join("".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(r.randint(low, high)))

    def sentence(low: int = 4, high: int = 40) -> str:
        return words(low, high).capitalize() + r.choice([".", ".", ".", "", "!", "?"])

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(n))

    def linked() -> str:
        return f"{sentence(6, 30)} <a href=/{r.randint(1, 99)}>{words(1, 4)}</a> {sentence(3, 30)}"

    def paragraphs(n: int, main: bool, forms: tuple[str, ...] = ("<p>{}</p>", "<p><b>{}</b></p>", "<p>{}", "<p><b>{}<br>", "<p>{}</p>")) -> str:
        m = mark if main else ""
        return "".join(r.choice(forms).format(m + (linked() if r.random() < 0.15 else sentence(*r.choice([(1, 3), (5, 30), (30, 120)])))) for _ in range(n))

    def anyname() -> str:
        return r.choice(["", f' class="{words(1, 1)}"', f" id={words(1, 1)}", f' class="row col-{r.randint(1, 12)}"', f" data-x={r.choice(['it’s', 'a"b', 7])}"])

    noise = {
        "nav": lambda: f"<nav><ul>{links(r.randint(2, 8))}</ul></nav>",
        "menu": lambda: f'<div class="menu"><ul>{links(r.randint(2, 8))}</ul></div>',
        "bar": lambda: f"<div{anyname()}>" + " | ".join(f'<a href="/{i}">{words(1, 2)}</a>' for i in range(r.randint(3, 9))) + "</div>",
        "links": lambda: f"<ul{anyname()}>{links(r.randint(3, 10))}</ul>",
        "header": lambda: f"<header><h2>{words(1, 4)}</h2><p>{sentence()}</p></header>",
        "ad": lambda: f'<div class="{r.choice(["ad", "ads", "advert", "banner", "promo", "sponsored"])}">{r.choice(["{}", "<p>{}</p>"]).format(sentence())}</div>',
        "aside": lambda: f"<aside>{paragraphs(r.randint(1, 3), False)}</aside>",
        "sidebar": lambda: f'<div id="sidebar"><h3>{words(1, 3)}</h3>{paragraphs(r.randint(1, 3), False)}<ul>{links(3)}</ul></div>',
        "cookie": lambda: f'<div class="{r.choice(["cookie-notice", "notice", "consent", "cookie-banner", "popup"])}"><p>{sentence()}</p><button>{words(1, 2)}</button></div>',
        "form": lambda: f'<form><label>{words(1, 3)}</label><input name="q"><p>{sentence()}</p><button>{words(1, 1)}</button></form>',
        "comments": lambda: f'<{(t := r.choice(["section", "div", "ol"]))} class="{r.choice(["comments", "comment-list", "replies"])}"><h3>{words(1, 2)}</h3>'
        + "".join(f'<div class="comment"><p>{sentence(3, 60)}</p></div>' for _ in range(r.randint(1, 4)))
        + f"</{t}>",
        "related": lambda: f'<div class="related"><h4>{words(1, 3)}</h4><ul>{links(4)}</ul></div>',
    }
    closing = {
        "footer": lambda: f"<footer>&copy; {words(1, 2)}.example &middot; {sentence()}</footer>",
        "footer div": lambda: f'<div class="footer"><p>&copy; {words(1, 3)}</p></div>',
        "line": lambda: f"<div{anyname()}>Copyright {r.randint(1990, 2030)} {words(1, 3)}</div>",
    }
    told = [("<article>", "</article>")] * 5 + [("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="post">', "</div>"), ("<main><article>", "</article></main>"), ('<div class="article-body">', "</div>")]
    bare = [("<div{}><div{}>", "</div></div>"), ("<div{}>", "</div>"), ("<section{}>", "</section>"), ("<table><tr><td{}>", "</td></tr></table>"), ("", ""), ("<div{}><div{}><div{}>", "</div></div></div>"), ("<center{}>", "</center>")]
    pages = []
    for _ in range(count):
        plain = r.random() < 0.4
        before = r.sample(sorted(noise), r.randint(0, 4))
        after = r.sample(sorted(noise), r.randint(0, 3))
        inside = r.sample(["ad", "comments", "aside", "form", "related", "cookie"], r.choice([0, 0, 1, 2]))
        forms = ("<p>{}</p>",) if r.random() < 0.5 else r.choice([("<p>{}</p>", "<p><b>{}</b></p>", "<p>{}", "<p><b>{}<br>", "<p>{}</p>"), ("<p{{}}>{}</p>".replace("{{}}", anyname()),), ("<div>{}</div>",)])
        body = "".join(paragraphs(r.randint(0, 6), True, forms) + noise[x]() for x in inside) + paragraphs(r.randint(1 + 2 * plain, 12), True, forms)
        if r.random() < 0.3:
            body += "<ul>" + "".join(f"<li>{mark}{sentence()}</li>" for _ in range(r.randint(1, 5))) + "</ul>"
        if r.random() < 0.2:
            body += f"<blockquote>{mark}{sentence()}</blockquote><h2>{mark}{words(1, 5)}</h2>" + paragraphs(2, True)
        if r.random() < 0.15:
            body += f"<table><caption>{mark}{words(2, 6)}</caption>" + "".join("<tr>" + "".join(f"<{t}>{mark}{r.choice([words(1, 3), str(r.randint(1, 9999))])}</{t}>" for _ in range(3)) + "</tr>" for t in ["th", *["td"] * r.randint(1, 5)]) + "</table>"
            body += paragraphs(r.randint(1, 3), True, forms)
        if r.random() < 0.15:
            body += f'<figure><img src="x.png"><figcaption>{mark}{sentence(3, 15)}</figcaption></figure><pre>{mark}{words(3, 20)}</pre>' + paragraphs(r.randint(1, 3), True, forms)
        if r.random() < 0.1:
            body += f"<dl><dt>{mark}{words(1, 3)}<dd>{mark}{sentence()}</dl>" + paragraphs(1, True, forms)
        if r.random() < 0.3:
            body += noise["comments"]()
        title = words(2, 9)
        head = f"<h1>{mark}{title}</h1>" if r.random() < 0.9 else ""
        a, z = r.choice(bare) if plain else r.choice(told)
        while "{}" in a:
            a = a.replace("{}", anyname(), 1)
        page = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>"
        page += "".join(noise[x]() for x in before) + a + head + body + z + "".join(noise[x]() for x in after)
        page += closing[r.choice(sorted(closing))]() if r.random() < 0.9 else ""
        page += "</body></html>" if r.random() < 0.9 else ""
        blocks = leaf_blocks(page)
        labels = [int(mark in b.text) for b in blocks]
        for b in blocks:
            b.text = b.text.replace(mark, "")
        pages.append((block_features(blocks), labels))
    return pages


@lru_cache(maxsize=1)
def trained() -> LinearChainCrf:
    return LinearChainCrf().fit(labelled_pages())


def main_text(page: str | None, model: LinearChainCrf) -> str:
    blocks = leaf_blocks(page or "")
    if not blocks:
        return ""
    labels = model.viterbi(model.unary(block_features(blocks)))
    return "\n\n".join(b.text for b, y in zip(blocks, labels, strict=True) if y)


def _extract(model: LinearChainCrf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, model) for h in batch.column("html").to_pylist()]
            out = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, model: LinearChainCrf | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages(page_id, url, html)."""
    p = pages.select("page_id", "url", "html")
    kinds = {n: p.schema[n].dataType.simpleString() for n in ("page_id", "url")}
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint"
    return p.mapInArrow(_extract(model or trained()), schema)
