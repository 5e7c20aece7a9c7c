"""Main text of web pages: boosted trees over DOM-node features, decoded so that the choices of a page agree.

A page becomes a tree of elements and text blocks. Each node gets features of its subtree (text, link and tag density,
paragraphs), of its attribute tokens and those of its ancestors, of depth and of its siblings; boosted trees give the
probability that the node holds main text. Decoding takes the likeliest labelling of the whole tree in which nothing
under a rejected node is kept, by dynamic programming from the leaves up.

The trees are fitted here, on ``TRAIN_PAGES`` pages of a seeded generator that knows which of its blocks are main text.

Elements that a browser doesn't show (``hidden``, ``display: none``, ``visibility: hidden``) hold no text, nor do inline
elements whose names say that they are adverts.

Defined cases: null and empty pages give the empty text; repeated rows repeat; broken markup is read as browsers do,
roughly: open elements end with their parents, unknown references stay as they are; long and deeply nested pages are read
whole, in time that grows with their length; an empty table gives no rows.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.llm.boosting import BoostedTrees
from voxelweave.llm.common import kernel, slices

TRAIN_PAGES, SEED = 500, 7

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
SILENT = frozenset("script style noscript template head title svg iframe object select textarea math canvas audio video button".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: A start tag of the key ends these open elements, unless one of the scope's elements lies between.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "tbody", "thead"), "body": ("head",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "tbody": ("table",), "body": ("html",)}

GOOD_TOKENS = frozenset("article articlebody content contents post entry body main story text prose page copy richtext paragraph lead headline blog news document maincontent postcontent entrycontent".split())
BAD_TOKENS = frozenset("nav navbar navigation menu menubar sidebar side aside footer foot bottom header head top masthead ad ads adv advert advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent notice gdpr alert comment comments disqus reply replies respond discussion share sharing social related recommended recommendations widget widgets popup modal overlay subscribe subscription newsletter signup login breadcrumb breadcrumbs pagination pager toolbar tags tagcloud copyright legal form search links skip toc rail teaser meta byline".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

#: Tokens that make an inline element an advert.
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising promo promotion sponsor sponsored".split())

ATTRIBUTES = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
UNSHOWN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
TAG_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
RAW_END = {t: re.compile(f"</{t}(?=[\\s/>])", re.I) for t in RAW}
MARKS = re.compile(r"[.,;:!?](?=\s|$)")


class Page:
    """Nodes in page order, parents before children. tag is #text for a text block."""

    __slots__ = ("attrs", "parent", "silent", "tag", "text")

    def __init__(self):
        self.tag, self.parent, self.attrs, self.text, self.silent = ["#root"], [-1], [""], [""], [False]

    def add(self, tag: str, parent: int, attrs: str = "", text: str = "", silent: bool = False) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.attrs.append(attrs)
        self.text.append(text)
        self.silent.append(silent or self.silent[parent] or tag in SILENT)
        return len(self.tag) - 1


def parse(source: str) -> Page:
    page, stack, names = Page(), [0], ["#root"]  # an inline element shares the node of the block around it
    places: dict[str, list[int]] = {}  # of the open elements of each name in the stack
    blocks = [0]  # places of the open elements that aren't inline
    unshown: list[int] = []  # places of open inline elements whose text isn't shown
    block: list[tuple[str, bool]] = []  # pieces of the open text block, and whether each lies in a link
    block_at = [0]  # its parent

    def flush():
        if block:
            text = " ".join("".join(x for x, _ in block).split())
            if text:
                plain = sum(len(x) for x, in_link in block if not in_link)
                page.add("#text", block_at[0], "" if plain * 2 > len(text) else "a", text)
            block.clear()

    def write(raw: str):
        if unshown or page.silent[stack[-1]]:
            return
        if not block:
            block_at[0] = stack[-1]
        block.append((html_lib.unescape(raw), bool(places.get("a"))))

    def last(*wanted: str) -> int:
        """The innermost open element of these names, or 0."""
        return max((places[n][-1] for n in wanted if places.get(n)), default=0)

    def open_element(tag: str, node: int):
        places.setdefault(tag, []).append(len(stack))
        stack.append(node)
        names.append(tag)

    def close_to(k: int):
        """Ends the open elements from stack position k on."""
        if blocks[-1] >= k:
            flush()
        while len(names) > k:
            places[names.pop()].pop()
            stack.pop()
        while blocks[-1] >= k:
            blocks.pop()
        while unshown and unshown[-1] >= k:
            unshown.pop()

    at, n = 0, len(source)
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            write(source[at:])
            break
        if lt > at:
            write(source[at:lt])
        nxt = source[lt + 1 : lt + 2]
        if nxt == "!" or nxt == "?":
            if source.startswith("<!--", lt):
                end = source.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            else:
                end = source.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        closing = nxt == "/"
        m = NAME.match(source, lt + 1 + closing)
        if not m:
            if closing:
                end = source.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                write("<")
                at = lt + 1
            continue
        tag = m[0].lower()
        rest = TAG_REST.match(source, m.end())
        if rest:
            end = rest.end()
        else:
            end = source.find(">", m.end()) + 1 or n
        attrs = source[m.end() : end - 1]
        at = end
        if closing:
            if tag == "p" and not places.get("p"):
                flush()
            k = last(tag)
            if k and not (tag in INLINE or tag in ("p", "li")) or k > last("article", "main", "body"):
                close_to(k)
            continue
        if tag in CLOSES_P and names[blocks[-1]] == "p":
            close_to(blocks[-1])
        for other in SIBLINGS.get(tag, ()):
            if (k := last(other)) > last(*SCOPE[tag]):
                close_to(k)
        if tag in INLINE:
            if tag == "br":
                write(" ")
                continue
        else:
            flush()
        if tag in VOID:
            continue
        hidden, advert = attribute_marks(attrs)[2:] if attrs else (0, 0)
        if tag in INLINE:
            if hidden == 2 or advert:
                unshown.append(len(stack))
            open_element(tag, stack[-1])
            continue
        node = page.add(tag, stack[-1], attrs, silent=bool(unshown) or hidden == 2)
        blocks.append(len(stack))
        open_element(tag, node)
        if tag in RAW:
            found = RAW_END[tag].search(source, at)
            at = found.start() if found else n
    flush()
    return page


@lru_cache(maxsize=50_000)
def attribute_marks(attrs: str) -> tuple[int, int, int, int]:
    """Good tokens, bad tokens, whether hidden (2: not shown at all, 1: from screen readers only), whether an advert."""
    good = bad = hidden = advert = 0
    for name, value in ATTRIBUTES.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "role":
            bad += value.lower() in BAD_ROLES
            good += value.lower() in ("main", "article")
        elif name == "hidden":
            hidden = 2
        elif name == "style":
            hidden = max(hidden, 2 * bool(UNSHOWN.search(value)))
        elif name == "aria-hidden":
            hidden = max(hidden, int(value.lower() == "true"))
        elif name in ("class", "id", "itemprop", "aria-label"):
            tokens = [t.lower() for t in TOKEN.findall(value)]
            good += sum(t in GOOD_TOKENS for t in tokens)
            bad += sum(t in BAD_TOKENS for t in tokens)
            advert |= name != "aria-label" and any(t in ADVERTS for t in tokens)
    return good, bad, hidden, int(advert)


GROUPS = [("article", "main"), ("nav",), ("header",), ("footer",), ("aside",), ("form", "fieldset", "input"), ("ul", "ol", "dl", "menu"), ("li", "dt", "dd"), ("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("div", "section"), ("table", "tr", "td", "th", "tbody", "thead"), ("blockquote", "pre", "figure", "figcaption"), ("#text",)]
GROUP = {t: k for k, group in enumerate(GROUPS) for t in group}


def features(pages: list[Page]) -> np.ndarray:
    """One row for each node of the pages, in order. Counts run over lists; arrays are made once for all pages."""
    n = sum(len(p.tag) for p in pages)
    cols: dict[str, list] = {k: [] for k in "parent tag good bad hidden length link marks depth mask above_good above_bad above_hidden text links stops tags paras kids biggest index left right before total silent".split()}
    unknown, block, para, first = len(GROUPS), GROUP["#text"], GROUP["p"], 0
    for page in pages:
        m = len(page.tag)
        tag = [GROUP.get(t, unknown) for t in page.tag]
        marks = [attribute_marks(a)[:3] if a and t != block else (0, 0, 0) for a, t in zip(page.attrs, tag)]
        length = [0 if s else len(t) for t, s in zip(page.text, page.silent)]
        text, tags, kids, biggest = list(length), [int(t != block) for t in tag], [0] * m, [0] * m
        links = [x if a == "a" and t == block else 0 for x, a, t in zip(length, page.attrs, tag)]
        stops = [len(MARKS.findall(t)) if t else 0 for t in page.text]
        paras = [int(t == para) for t in tag]
        depth, mask, index, before = [0] * m, [0] * m, [0] * m, [0] * m
        good, bad, hidden = [0] * m, [0] * m, [0] * m
        parent = page.parent
        for v in range(1, m):
            u = parent[v]
            depth[v] = depth[u] + 1  # of elements that aren't inline
            mask[v] = mask[u] | 1 << tag[u]
            g, b, h = marks[u]
            good[v], bad[v], hidden[v] = good[u] + g, bad[u] + b, hidden[u] | h
            index[v] = kids[u]
            kids[u] += 1
            before[v] = before[v - 1] + length[v - 1]
        for v in range(m - 1, 0, -1):
            u = parent[v]
            text[u] += text[v]
            links[u] += links[v]
            stops[u] += stops[v]
            tags[u] += tags[v]
            paras[u] += paras[v]
            if text[v] > biggest[u]:
                biggest[u] = text[v]
        last, left, right = [0] * m, [0] * m, [0] * m
        for v in range(1, m):
            u = parent[v]
            k = last[u]
            if k:
                left[v], right[k] = text[k], text[v]
            last[u] = v
        for name, values in (("parent", [max(0, u) + first for u in parent]), ("tag", tag), ("good", [x[0] for x in marks]), ("bad", [x[1] for x in marks]), ("hidden", [x[2] for x in marks]), ("depth", depth), ("mask", mask), ("above_good", good), ("above_bad", bad), ("above_hidden", hidden), ("text", text), ("links", links), ("stops", stops), ("tags", tags), ("paras", paras), ("kids", kids), ("biggest", biggest), ("index", index), ("left", left), ("right", right), ("before", before), ("total", [max(text[0], 1)] * m), ("silent", page.silent)):
            cols[name] += values
        first += m
    c = {k: np.array(v, np.int64) for k, v in cols.items()}
    up, text = c["parent"], c["text"]
    dense = [
        np.log1p(text), text / c["total"], c["links"] / np.maximum(text, 1), c["stops"] / np.maximum(text / 40, 1), np.log1p(text / np.maximum(c["tags"], 1)), np.log1p(c["paras"]), np.log1p(c["tags"]), np.log1p(c["kids"]), c["biggest"] / np.maximum(text, 1),
        c["depth"], c["index"] / np.maximum(c["kids"][up], 1), np.log1p(c["kids"][up]), np.log1p(c["left"]), np.log1p(c["right"]), text / np.maximum(text[up], 1), c["before"] / c["total"], c["links"][up] / np.maximum(text[up], 1), np.log1p(text[up]),
        c["good"] > 0, c["bad"] > 0, c["hidden"], c["above_good"] > 0, c["above_bad"] > 0, c["above_hidden"], c["silent"], np.minimum(c["above_bad"], 3) - np.minimum(c["above_good"], 3),
    ]
    out = np.empty((n, len(dense) + 2 * len(GROUPS)), np.float32)
    for j, x in enumerate(dense):
        out[:, j] = x
    for k in range(len(GROUPS)):
        out[:, len(dense) + k] = c["tag"] == k
        out[:, len(dense) + len(GROUPS) + k] = (c["mask"] >> k) & 1
    return out


def decode(page: Page, p: np.ndarray) -> np.ndarray:
    """The likeliest labels in which no node is kept under a rejected one. Silent and hidden nodes are rejected."""
    n = len(p)
    p = np.clip(p, 1e-4, 1 - 1e-4)
    keep, drop = np.log(p).tolist(), np.log(1 - p).tolist()
    for v in range(n - 1, 0, -1):
        if page.silent[v]:
            keep[v] = -1e9
        u = page.parent[v]
        keep[u] += max(keep[v], drop[v])
        drop[u] += drop[v]
    label = np.zeros(n, bool)
    label[0] = True
    for v in range(1, n):
        label[v] = label[page.parent[v]] and keep[v] >= drop[v]
    return label


def main_text(page: Page, label: np.ndarray) -> str:
    return "\n".join(t for t, k, tag in zip(page.text, label, page.tag) if k and tag == "#text")


# ---------------------------------------------------------------- pages to learn from


def made_page(rng: random.Random) -> tuple[str, set[str]]:
    """A page and the set of its main-text blocks. Layouts, names and junk vary; words are random syllables."""
    syllables = "ba co di fu ge hi jo ka lu mi no pa qui re so ta u ve wi xo ya zu th er on an in st".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    serial = [0]

    def phrase(low: int, high: int, stop: str = ".") -> str:
        serial[0] += 1
        found = [word() for _ in range(rng.randint(min(low, high), high))]
        for k in range(rng.randint(5, 12), len(found), rng.randint(6, 14)):
            found[k - 1] += rng.choice([",", ".", "."])
        return f"{' '.join(found)} {serial[0]}{stop}".capitalize()

    main: set[str] = set()

    def content(text: str) -> str:
        main.add(" ".join(text.split()))
        return text

    named = lambda *names: rng.choice([f' class="{rng.choice(names)}"', f' id="{rng.choice(names)}"', f' class="{rng.choice(names)} {word()}"'])
    link = lambda: f'<a href="/{word()}">{phrase(1, 3, "")}</a>'
    links = lambda k: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(k)) + "</ul>"
    semantic = rng.random() < 0.6

    def menu() -> str:
        inner = links(rng.randint(3, 9))
        return f"<nav{rng.choice(['', named('menu', 'navbar')])}>{inner}</nav>" if semantic or rng.random() < 0.3 else f"<div{named('nav', 'menu', 'navigation', 'top-menu')}>{inner}</div>"

    def advert() -> str:
        return f"<div{named('ad', 'ads', 'advert', 'banner', 'sponsored', 'promo-box')}>{rng.choice(['', '<p>'])}{phrase(3, 30)}</div>"

    def notice() -> str:
        return f"<div{named('cookie-notice', 'consent', 'notice', 'gdpr', 'alert')}>{rng.choice(['<p>', ''])}{phrase(6, 30)}</div>" + rng.choice(["", f"<div{named('notice', 'alert')}><p>{phrase(5, 20)}</p></div>"])

    def form() -> str:
        return f"<form{rng.choice(['', named('newsletter', 'search', 'subscribe', 'login')])}><p>{phrase(3, 12)}</p><label>{phrase(1, 2, '')}</label><input name=q><button>{word()}</button></form>"

    def sidebar() -> str:
        tag = "aside" if semantic else "div"
        inner = "".join(rng.choice([lambda: f"<h3>{phrase(1, 3, '')}</h3>{links(rng.randint(2, 6))}", lambda: f"<p>{phrase(8, 40)}</p>", form])() for _ in range(rng.randint(1, 3)))
        return f"<{tag}{named('sidebar', 'side', 'related', 'widget') if tag == 'div' or rng.random() < 0.5 else ''}>{inner}</{tag}>"

    def comments() -> str:
        tag = "section" if semantic else "div"
        one = lambda: f"<{rng.choice(['div', 'li', 'article'])}{named('comment', 'reply')}><p>{phrase(5, 60)}</p>"
        body = ""
        for _ in range(rng.randint(1, 5)):
            made = one()
            body += made + f"</{made[1 : made.index(' ')]}>"
        return f"<{tag}{named('comments', 'discussion', 'respond')}><h2>{phrase(1, 2, '')}</h2>{body}</{tag}>"

    def header() -> str:
        tag = "header" if semantic else "div"
        return f"<{tag}{rng.choice(['', named('header', 'masthead', 'top')]) if semantic else named('header', 'masthead', 'top')}>{rng.choice(['', f'<h2>{phrase(1, 4, str())}</h2>'])}<p>{phrase(2, 8)}</p>{rng.choice(['', menu()])}</{tag}>"

    def footer() -> str:
        tag = "footer" if semantic else "div"
        return f"<{tag}{rng.choice(['', named('footer', 'bottom')]) if semantic else named('footer', 'bottom', 'copyright')}>{rng.choice(['&copy; ', '', '<p>'])}{phrase(2, 25)}{rng.choice(['', links(3)])}</{tag}>"

    def article() -> str:
        parts = [f"<h1>{content(phrase(3, 12, ''))}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.randint(1, 14)):
            roll = rng.random()
            if roll < 0.66:
                parts.append(f"<p>{content(phrase(rng.choice([1, 3, 10]), rng.choice([4, 30, 120])))}{rng.choice(['</p>', '</p>', ''])}")
            elif roll < 0.74:
                parts.append(f"<p><b>{content(phrase(2, 25))}<br>")
            elif roll < 0.80:
                parts.append(f"<h2>{content(phrase(1, 6, ''))}</h2>")
            elif roll < 0.86:
                parts.append("<ul>" + "".join(f"<li>{content(phrase(2, 15))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif roll < 0.90:
                parts.append(f"<blockquote><p>{content(phrase(5, 40))}</p></blockquote>")
            elif roll < 0.93:
                parts.append(f"<table><tr><td>{content(phrase(1, 6, ''))}</td><td>{content(phrase(1, 6, ''))}</td></tr></table>")
            else:
                parts.append(rng.choice([advert, form, advert, notice, sidebar])())
        inner = "".join(parts)
        if rng.random() < 0.25:
            inner += f"<div{named('share', 'social', 'tags')}>{links(3)}</div>"
        if semantic:
            return f"<article{rng.choice(['', '', named('post', 'story')])}>{inner}</article>"
        return f"<div{rng.choice([named('content', 'post', 'article-body', 'entry-content', 'main', 'story'), named('content', 'post'), ' class=' + word()])}>{inner}</div>"

    roll = rng.random()
    if roll < 0.04:  # plain text or a mere fragment
        return content(phrase(5, 60)), main
    if roll < 0.10:
        kind = rng.choice(["{}", "<html><body>{}</body></html>", "<div>{}</div>"])
        return kind.format("".join(f"<p>{content(phrase(1, 60))}</p>" for _ in range(rng.randint(1, 6)))), main
    before = rng.sample([header, menu, advert, notice, form], rng.randint(1, 4))
    after = rng.sample([sidebar, comments, advert, form, notice], rng.randint(0, 3)) + [footer] * (rng.random() < 0.9)
    if rng.random() < 0.3:
        before.append(sidebar)
    body = "".join(f() for f in before) + "{}" + "".join(f() for f in after)
    mid = article()
    if rng.random() < 0.35:
        mid = rng.choice(["<main>{}</main>", "<div class=wrapper>{}</div>", "<div id=page><div class=row>{}</div></div>"]).format(mid + (comments() if rng.random() < 0.3 else ""))
    return f'<!DOCTYPE html><html><head><title>{phrase(2, 8)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>' + body.replace("{}", mid) + rng.choice(["</body></html>", "", "</body></html>"]), main


def node_labels(page: Page, main: set[str]) -> np.ndarray:
    """1 if a node is, or holds, a main-text block."""
    y = np.array([tag == "#text" and text in main for tag, text in zip(page.tag, page.text)], float)
    for v in range(len(y) - 1, 0, -1):
        y[page.parent[v]] = max(y[page.parent[v]], y[v])
    return y


@lru_cache(maxsize=1)
def fitted(pages: int = TRAIN_PAGES, seed: int = SEED) -> BoostedTrees:
    rng, made, ys = random.Random(seed), [], []
    for _ in range(pages):
        source, main = made_page(rng)
        page = parse(source)
        made.append(page)
        ys.append(node_labels(page, main))
    return BoostedTrees(trees=60, depth=5, rate=0.3).fit(features(made), np.concatenate(ys))


def extract_many(sources: list[str | None], model: BoostedTrees) -> list[str]:
    pages = [parse(s) for s in sources if s]
    texts = iter(())
    if pages:
        scores = np.split(model.predict(features(pages)), np.cumsum([len(p.tag) for p in pages])[:-1])
        texts = iter([main_text(p, decode(p, x)) for p, x in zip(pages, scores)])
    return [next(texts) if s else "" for s in sources]


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row for each input row."""
    shared = df.sparkSession.sparkContext.broadcast(fitted())

    def run(batches):
        model = shared.value
        for b in slices(batches, 64):
            texts = extract_many(b.column(2).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return kernel(rows, run, "page_id long, url string, text string, n_chars long")
