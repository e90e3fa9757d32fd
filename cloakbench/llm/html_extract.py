"""HTML main-text extraction: a recurrent labeller of leaf blocks.

A tolerant tokenizer cuts a page into leaf blocks (text between block-level tags; comments, scripts, styles, templates and the head
are no blocks, unless never closed; tags inside math and svg break no block) with their tag paths. Each block becomes the sum of learned vectors of its path parts (tags, class and id words, near and
far), the mean of learned vectors of all its hashed words, and a few lengths and shares. A bidirectional LSTM in numpy reads
the whole sequence of a page and labels every block main or not, so each decision sees the whole document. It is trained here,
on pages drawn by a seeded generator (layouts, class names, nested boilerplate, unclosed tags; words of four languages and what menus, notices
and adverts say) whose labels are known. Words that it does not know have the vector 0.

Defined cases: null or empty html has the empty text; a page without blocks or without a main block has the empty text; unclosed and
stray tags are tolerated; repeated rows give equal texts; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .features import Adam, sigmoid

PATHS, WORDS = 1 << 12, 1 << 12
PATH_DIM, WORD_DIM, PLAIN, HIDDEN = 24, 8, 8, 24
WIDE = PATH_DIM + WORD_DIM + PLAIN
NEAR = 2  # innermost path elements that count as near

#: Fixed values of HTML: elements whose content is no text, that have no content, and that do not break a block.
RAW = {"script", "style", "template", "head"}
FOREIGN = {"math", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "math", "object", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "svg", "time", "tt", "u", "var", "wbr"}
#: An opening tag of the key ends an open element of these kinds, as HTML's optional end tags have it.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "pre", "section", "table", "ul"}

_token = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>""", re.S)
_named = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_parts = re.compile(r"[a-z]+")
_letters = re.compile(r"[^\W\d_]+").findall


class Block(NamedTuple):
    text: str
    path: tuple[str, ...]
    linked: int  # characters inside links


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order, references decoded, white space single."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    got: list[str] = []
    linked, links, at, foreign_to, spaced = 0, 0, 0, 0, False
    unclosed: set[str] = set()  # tags without an end tag in the rest of the page, so that each is looked for once
    sought = {t: re.compile(rf"</{t}\s*>" if t != "head" else r"</head\s*>|<body\b", re.I) for t in RAW | FOREIGN}

    def end_of(tag: str):
        end = None if tag in unclosed else sought[tag].search(page, at)
        if end is None:
            unclosed.add(tag)
        return end

    def flush() -> None:
        nonlocal linked
        if got:
            text = " ".join(entities.unescape("".join(got)).split())
            if text:
                names = [x for tag, x in stack if tag not in INLINE]
                near, far = names[-NEAR:], names[:-NEAR]
                out.append(Block(text, tuple("n:" + p for x in near for p in x) + tuple("f:" + p for x in far for p in x), min(linked, len(text))))
            got.clear()
        linked = 0

    for m in iter(lambda: _token.search(page, at), None):
        if m.start() > at:
            got.append(page[at : m.start()])
            if links:
                linked += m.start() - at
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW and not closing:
            flush() if tag == "head" else None
            end = end_of(tag)
            if end is not None:
                at = end.start() if end[0].lower().startswith("<body") else end.end()
            continue
        if tag in FOREIGN and not closing and not m[3].endswith("/") and (end := end_of(tag)) is not None:
            foreign_to, spaced = max(foreign_to, end.end()), tag == "svg"
        if m.start() < foreign_to and tag not in INLINE:
            got.append(" " if spaced else "")
            continue
        if tag in INLINE:
            if tag in ("br", "wbr", "img"):
                got.append(" " if tag == "br" else "")
            elif tag == "a":
                links = max(0, links - 1) if closing else links + 1
            continue
        flush()
        links = 0
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in VOID:
            continue
        shut = ENDS.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
        while stack and stack[-1][0] in shut:
            stack.pop()
        words = [w for a in _named.findall(m[3]) for w in _parts.findall("".join(a).lower())]
        stack.append((tag, (tag, *("." + w for w in words))))
        if m[3].endswith("/") and tag in ("div", "span"):
            stack.pop()
    got.append(page[at:])
    flush()
    return out


def vectors(page: list[Block]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """(path rows, word rows, plain numbers) of each block."""
    path = [np.array([zlib.crc32(p.encode()) % PATHS for p in b.path] or [0], np.int64) for b in page]
    words = [np.array([zlib.crc32(w.encode()) % WORDS for w in _letters(b.text.lower())], np.int64) for b in page]
    plain, n = np.zeros((len(page), PLAIN)), max(1, len(page))
    for k, b in enumerate(page):
        size = len(b.text)
        plain[k] = (1, np.log1p(size) / 8, b.linked / size, min(1, size / 400), k / n, (b.text.count(".") + b.text.count(",")) / (1 + size / 20), b.text[-1] in ".!?", b.text.count(" ") < 4)
    return path, words, plain


class Net(NamedTuple):
    paths: np.ndarray
    words: np.ndarray
    wx: np.ndarray  # 2 directions
    wh: np.ndarray
    b: np.ndarray
    out: np.ndarray
    skip: np.ndarray
    bias: np.ndarray


def _embed(net: Net, pages: list) -> tuple[np.ndarray, np.ndarray]:
    """(input by step, page; mask), padded to the longest page."""
    steps = max(len(p[0]) for p in pages)
    x, mask = np.zeros((steps, len(pages), WIDE)), np.zeros((steps, len(pages), 1))
    for k, (path, words, plain) in enumerate(pages):
        n = len(path)
        if not n:
            continue
        ends = np.cumsum([0, *map(len, path)])
        x[:n, k, :PATH_DIM] = np.add.reduceat(net.paths[np.concatenate(path)], ends[:-1], axis=0)
        counts = np.array(list(map(len, words)))
        flat = net.words[np.concatenate(words)] if counts.sum() else np.zeros((0, WORD_DIM))
        total = np.concatenate((np.zeros((1, WORD_DIM)), np.cumsum(flat, axis=0)))
        at = np.cumsum([0, *counts])
        x[:n, k, PATH_DIM : PATH_DIM + WORD_DIM] = (total[at[1:]] - total[at[:-1]]) / np.maximum(1, counts)[:, None]
        x[:n, k, PATH_DIM + WORD_DIM :] = plain
        mask[:n, k] = 1
    return x, mask


def _run(net: Net, x: np.ndarray, mask: np.ndarray, keep: bool = False):
    steps, many, _ = x.shape
    hidden, saved = np.zeros((2, steps, many, HIDDEN)), []
    for d in (0, 1):
        h, c = np.zeros((many, HIDDEN)), np.zeros((many, HIDDEN))
        pre = x @ net.wx[d] + net.b[d]
        log = []
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            z = pre[t] + h @ net.wh[d]
            ifo, g = sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = ifo[:, :HIDDEN], ifo[:, HIDDEN : 2 * HIDDEN], ifo[:, 2 * HIDDEN :]
            new = (f * c + i * g) * mask[t]
            th = np.tanh(new)
            if keep:
                log.append((t, h, c, i, f, o, g, th))
            h, c = o * th * mask[t], new
            hidden[d, t] = h
        saved.append(log)
    logits = hidden[0] @ net.out[:HIDDEN] + hidden[1] @ net.out[HIDDEN:] + x @ net.skip + net.bias
    return logits, hidden, saved


def _gradients(net: Net, pages: list, labels: list[np.ndarray]):
    x, mask = _embed(net, pages)
    y = np.zeros(mask.shape[:2])
    for k, l in enumerate(labels):
        y[: len(l), k] = l
    logits, hidden, saved = _run(net, x, mask, keep=True)
    g = ((sigmoid(logits) - y) * mask[..., 0]) / mask.sum()
    d = Net(*[np.zeros_like(p) for p in net])
    d.bias[0] = g.sum()
    d.skip[:] = np.einsum("tb,tbd->d", g, x)
    d.out[:HIDDEN], d.out[HIDDEN:] = (np.einsum("tb,tbh->h", g, h) for h in hidden)
    dx = g[..., None] * net.skip
    for way in (0, 1):
        out = net.out[way * HIDDEN : (way + 1) * HIDDEN]
        dh, dc = np.zeros((x.shape[1], HIDDEN)), np.zeros((x.shape[1], HIDDEN))
        for t, h, c, i, f, o, gg, th in reversed(saved[way]):
            dh = (dh + g[t][:, None] * out) * mask[t]
            dn = (dc + dh * o * (1 - th * th)) * mask[t]
            dz = np.concatenate((dn * gg * i * (1 - i), dn * c * f * (1 - f), dh * th * o * (1 - o), dn * i * (1 - gg * gg)), 1)
            d.wx[way] += x[t].T @ dz
            d.wh[way] += h.T @ dz
            d.b[way] += dz.sum(0)
            dx[t] += dz @ net.wx[way].T
            dh, dc = dz @ net.wh[way].T, dn * f
    for k, (path, words, _) in enumerate(pages):
        for t, (p, w) in enumerate(zip(path, words)):
            np.add.at(d.paths, p, dx[t, k, :PATH_DIM])
            if len(w):
                np.add.at(d.words, w, dx[t, k, PATH_DIM : PATH_DIM + WORD_DIM] / len(w))
    return d


MARK = "\x01"

#: Words of drawn texts: common ones of four languages, and what menus, notices and the like say.
PROSE = (
    "the of and to in that was for with his this from they had which were there been one their when who more into time some could other than then its "
    "people only over after also many before first world long house water country year night state never left while place old think might found light "
    "der die und das ist nicht ein mit auch sich auf für von war haben werden wird noch nach aber über durch wenn mehr immer zeit jahr menschen land stadt "
    "le les des une dans est pour pas que qui sur avec son plus par mais nous tout fait être comme temps homme jour monde pays ville eau maison année "
    "el los las una por con para como pero más este todo sobre entre cuando muy también hasta desde vida tiempo mundo casa hombre país agua ciudad años"
).split()
SAYS = {
    "menu": "home about contact products services blog news login register search menu archive categories tags next previous page top skip content",
    "advert": "sponsored advertisement buy shop sale free shipping offer deal limited price click order promo discount save",
    "notice": "cookies improve experience accept reject settings privacy policy consent learn agree continuing site",
    "form": "subscribe newsletter enter email address send submit name password updates weekly inbox join",
    "footer": "copyright rights reserved terms service privacy policy imprint impressum contact sitemap powered company inc",
    "related": "related articles read popular posts trending recommended latest stories like share follow print tweet",
    "comment": "reply posted said says ago thanks great post agree comment report anonymous leave user wrote nice",
}
SAYS = {k: v.split() for k, v in SAYS.items()}


def drawn_page(rng: np.random.Generator) -> str:
    """A page whose main blocks begin with MARK."""
    pick = lambda *x: x[rng.integers(len(x))]
    chance = lambda p: rng.random() < p
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve qu mi ça ño ü ß ée ción".split()
    style = pick("{}", "{}", "{}", "{}", "{}***", "{}!!", "| {}", "{}&amp;&amp;", "{},")
    shout = chance(0.1)
    speaks: list[str] = []  # the kind of block that is being drawn

    def word() -> str:
        if speaks and chance(0.4):
            return pick(*SAYS[speaks[-1]])
        return pick(*SAYS[pick(*SAYS)]) if chance(0.05) else pick(*PROSE)

    def words(low: int, high: int) -> str:
        w = [word() for _ in range(rng.integers(low, high + 1))]
        text = " ".join(style.format(x) if chance(0.9) else x for x in w).capitalize() + pick(".", ".", "", "!")
        return text.upper() if shout else text

    def sized() -> str:
        return words(*pick((1, 3), (3, 12), (12, 40), (12, 40), (40, 90)))

    def named(*names: str) -> str:
        if not names:
            return ""
        n = pick(*names) + pick("", "", "-box", "_1", "-wrap", " block", " x" + pick(*syllables))
        return f' {pick("class", "class", "id")}="{n}"'

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{words(1, 1)}">{words(1, 3)}</a></li>' if chance(0.8) else f"<li>{words(1, 4)}</li>" for _ in range(n))

    def para(text: str, mark: str) -> str:
        kind = pick("p", "p", "p", "p", "div", "li", "h2", "h3", "blockquote", "pre", "td", "figcaption", "dd")
        text = mark + (text if chance(0.8) else f"<{pick('b', 'em', 'a', 'span')}>{text}</{pick('b', 'em', 'a', 'span')}>")
        if kind == "li":
            return f"<ul><li>{text}</li><li>{mark}{words(2, 15)}</li></ul>"
        if kind == "td":
            return f"<table><tr><td>{text}</td><td>{mark}{words(1, 4)}</td></tr></table>"
        if kind == "dd":
            return f"<dl><dt>{mark}{words(1, 4)}</dt><dd>{text}</dd></dl>"
        if kind == "p" and chance(0.25):
            return f"<p>{pick('', '<b>')}{text}{pick('', '<br>')}"
        return f"<{kind}>{text}</{kind}>"

    def spoken(kind: str, make) -> str:
        speaks.append(kind)
        try:
            return make()
        finally:
            speaks.pop()

    def comments() -> str:
        return spoken("comment", commented)

    def commented() -> str:
        one = lambda: f"<{pick('div', 'li', 'article', 'p')}{named('comment', 'comment-body', 'reply', 'user-comment')}><p>{sized()}</p>{pick('', '<span>' + words(1, 3) + '</span>')}"
        tag = pick("div", "section", "ol", "ul")
        return f"<{tag}{named('comments', 'comment-list', 'commentlist', 'responses', 'disqus', 'discussion', 'reader-comments')}>{pick('', f'<h3>{words(1, 3)}</h3>')}" + "".join(one() + pick("</div>", "</li>", "</p>") for _ in range(rng.integers(1, 5))) + f"</{tag}>"

    def junk(inside: bool) -> str:
        body = lambda: pick(sized(), f"<p>{sized()}</p>", f"<ul>{links(rng.integers(1, 6))}</ul>", f"<h4>{words(1, 4)}</h4><p>{sized()}</p>", f"<p>{sized()}</p><p>{sized()}</p>")
        kinds: list[tuple] = [
            ("advert", lambda: f"<div{named('ad', 'ads', 'advert', 'advertisement', 'banner', 'sponsored', 'sponsor', 'promo', 'adsense')}>{body()}</div>"),
            ("related", lambda: f"<aside{named('sidebar', 'related', 'aside', 'widget') if chance(0.5) else ''}>{body()}</aside>"),
            ("related", lambda: f"<div{named('sidebar', 'side', 'related', 'related-posts', 'widget', 'recommended', 'more', 'trending', 'popular')}>{body()}</div>"),
            ("related", lambda: f"<div{named('share', 'social', 'sharing', 'tags', 'breadcrumb', 'breadcrumbs', 'pagination', 'pager', 'toolbar')}>{pick(links(3), words(1, 8))}</div>"),
            ("form", lambda: f"<form{named('newsletter', 'search', 'login', 'subscribe', 'signup', 'contact') if chance(0.5) else ''}>{pick('', f'<p>{sized()}</p>')}<label>{words(1, 4)}</label><input><button>{words(1, 2)}</button></form>"),
            ("notice", lambda: f"<div{named('cookie', 'cookies', 'notice', 'consent', 'gdpr', 'alert', 'banner', 'popup', 'modal', 'newsletter', 'subscribe', 'message', 'disclaimer', 'privacy')}>{body()}</div>"),
            ("menu", lambda: f"<nav{named('nav', 'menu', 'toc') if chance(0.3) else ''}>{pick(f'<ul>{links(rng.integers(1, 8))}</ul>', words(2, 8))}</nav>"),
            ("comment", comments),
        ]
        if not inside:
            kinds += [
                ("footer", lambda: f"<footer{named('footer', 'site-footer') if chance(0.3) else ''}>{pick('&copy; ', '')}{body()}</footer>"),
                ("footer", lambda: f"<div{named('footer', 'bottom', 'copyright', 'legal', 'colophon')}>{pick('&copy; ', '')}{body()}</div>"),
                ("menu", lambda: f"<header{named('header', 'site-header', 'masthead') if chance(0.3) else ''}><{pick('h1', 'div', 'p', 'h2')}>{words(1, 6)}</{pick('h1', 'div', 'p')}>{pick('', f'<p>{sized()}</p>')}</header>"),
                ("menu", lambda: f"<div{named('header', 'masthead', 'top', 'topbar', 'logo', 'menu', 'nav', 'navbar', 'navigation', 'skip')}>{body()}</div>"),
                ("related", lambda: f"<section{named('comments', 'related', 'newsletter', 'sidebar', 'recommended')}>{body()}</section>"),
            ]
        return spoken(*kinds[rng.integers(len(kinds))])

    main = pick("article", "article", "article", "main", "section", "div", "div", "td")
    need = main in ("div", "td", "section")
    name = named("content", "main", "main-content", "post", "post-content", "entry", "entry-content", "article", "article-body", "story", "text", "body", "article-text") if need or chance(0.2) else pick("", "", ' role="main"')
    inner = []
    if chance(0.7):
        inner.append(f"<{pick('h1', 'h1', 'h2')}>{MARK}{words(1, 10)}</{pick('h1', 'h1', 'h2')}>")
    for _ in range(rng.integers(1, 12)):
        inner.append(para(sized(), MARK))
        if chance(0.08):
            inner.append(junk(True))
    if chance(0.15):
        inner.append(comments())
    body = "".join(inner)
    if chance(0.2):
        body = f"<div{named('content', 'text', 'inner', 'wrap') if chance(0.6) else ''}>{body}</div>"
    body = f"<{main}{name}>{body}</{main}>"
    if main == "td":
        body = f"<table><tr><td{named('menu', 'left', 'sidebar')}>{spoken('menu', lambda: links(4))}</td>{body}</tr></table>"
    elif main != "main" and chance(0.2):
        body = f"<main>{body}{pick('', comments())}</main>"
    parts = [junk(False) for _ in range(rng.integers(0, 4))] + [body] + [junk(False) for _ in range(rng.integers(0, 4))]
    page = "".join(parts)
    if chance(0.4):
        page = f"<div{named('wrapper', 'container', 'page', 'site', 'layout', 'main') if chance(0.8) else ''}>{page}</div>"
    return f"<html><head><title>{words(1, 6)}</title></head><body>{page}</body></html>"


def drawn(n: int, seed: int):
    rng, pages, labels = np.random.default_rng(seed), [], []
    while len(pages) < n:
        found = blocks(drawn_page(rng))
        y = np.array([b.text.startswith(MARK) for b in found], float)
        if len(found):
            path, words, plain = vectors([b._replace(text=b.text.lstrip(MARK).strip() or "x") for b in found])
            # Half of the pages speak a language that is not known.
            pages.append((path, [w[:0] for w in words] if rng.random() < 0.5 else words, plain))
            labels.append(y)
    return pages, labels


def train(pages: int = 1_500, epochs: int = 10, batch: int = 25, rate: float = 0.01, seed: int = 3) -> Net:
    rng = np.random.default_rng(seed)
    net = Net(rng.normal(0, 0.1, (PATHS, PATH_DIM)), np.zeros((WORDS, WORD_DIM)), rng.normal(0, 0.15, (2, WIDE, 4 * HIDDEN)), rng.normal(0, 0.15, (2, HIDDEN, 4 * HIDDEN)), np.zeros((2, 4 * HIDDEN)), rng.normal(0, 0.15, 2 * HIDDEN), np.zeros(WIDE), np.zeros(1))
    net.b[:, HIDDEN : 2 * HIDDEN] = 1
    x, y = drawn(pages, seed)
    opt = Adam([p.shape for p in net], rate)
    size = np.array([len(p[0]) for p in x])
    for epoch in range(epochs):
        opt.rate = rate * (1 - 0.9 * epoch / epochs)
        order = np.argsort(size + rng.normal(0, 3, len(size)), kind="stable")
        groups = np.array_split(order, max(1, len(x) // batch))
        for k in rng.permutation(len(groups)):
            own = groups[k]
            opt.step(list(net), list(_gradients(net, [x[j] for j in own], [y[j] for j in own])))
    return net


def label(net: Net, pages: list[list[Block]], most: int = 4096) -> list[np.ndarray]:
    """True for the main blocks of each page; pages of like length run together, at most about `most` padded blocks."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    while order:
        take = max(1, min(len(order), most // len(pages[order[-1]])))
        own, order = order[-take:], order[:-take]
        made = [vectors(pages[k]) for k in own]
        logits, _, _ = _run(net, *_embed(net, made))
        for col, k in enumerate(own):
            out[k] = logits[: len(pages[k]), col] > 0
    return out


_net: dict[tuple, Net] = {}


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), net: Net | None = None) -> DataFrame:
    """keep columns, text, n_chars (code points) per page."""
    shared = pages.sparkSession.sparkContext.broadcast(net or _net.get(()) or _net.setdefault((), train()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                cut = [blocks(t.as_py()) for t in b.column(b.num_columns - 1)]
                texts = ["\n".join(x.text for x, m in zip(p, main) if m) for p, main in zip(cut, label(shared.value, cut))]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*[f"c{k}" for k in range(len(keep))], "text", "n_chars"])

    rows = pages.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(keep)], F.col(html_col).cast("string").alias("html"))
    made = T.StructType([*list(rows.schema)[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(run, made).select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(keep)], "text", "n_chars")


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
