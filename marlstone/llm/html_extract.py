"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of block elements with its text blocks as leaves. Every node is content or not. Unary potentials
come from a node's features (tag, hints in class and id, length, links); parent-child potentials connect the nodes.
Sum-product messages go upward and downward once, which is exact on a tree, and give each node's content marginal; text
blocks of a marginal of one half or more are the page's text. Weights maximize the conditional likelihood of labelled
pages (gradient: observed less expected counts, both from the same messages). No labelled pages exist among the inputs,
so ``labelled_pages`` writes them: varied layouts whose blocks are known to be article or not.

Pages are parsed and judged where they are read, many at a time: messages of all pages move depth by depth.

Defined results: null or empty html gives empty text and 0; broken markup (unclosed or cut tags, cut comments) is read
as browsers do: what is open ends with the page; ``br`` ends a block; scripts, styles, form controls and comments are no
text; an open quote without its end closes with its tag; a control without an end tag ends at the next block, media
without one have no content; formatting that ends inside a block leaves the block whole; repeated rows give equal rows; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import small_batches, tidy

#: HTML's own sets of element names.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe".split())
CONTROLS = frozenset("select optgroup option button".split())
MEDIA = frozenset("template svg object canvas audio video".split())
SKIP = CONTROLS | MEDIA
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var nobr center".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SELF_CLOSE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE_END = frozenset("ul ol table article section div main body".split())
SECTIONS = frozenset("article aside section main header footer nav h1 h2 h3 h4 h5 h6".split())
CLOSE_SCOPE = {"li": {"ul", "ol"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "p": {"td", "th", "table"}}
TAGS = "article main section div p h1 h2 h3 h4 ul ol li nav header footer aside form table tr td blockquote pre figure figcaption dl dd dt body fieldset".split()
HINTS = [r"\bad\b|\bads\b|advert|sponsor|promo|banner", r"nav|menu|breadcrumb|toolbar|pagination|pager", r"foot|copyright|legal|imprint", r"side|widget|related|recommend|rail|teaser", r"comment|repl(y|ies)|discussion|disqus|feedback", r"cookie|consent|notice|alert|popup|modal|newsletter|subscri|signup|login|search", r"share|social|tags?\b|author|meta\b|byline", r"content|article|post\b|entry|story|\bmain\b|\bbody\b|\btext\b", r"head|masthead|logo|top\b"]
_HINTS = [re.compile(h) for h in HINTS]
# a value's quote may be missing, or stand inside an unquoted value; an open quote without its end closes at the tag's end
_VALUE = r"""=\s*+(?:"[^"]*+"|'[^']*+'|["'][^>]*+|[^\s>"'][^\s>]*+)?"""
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|{_VALUE})*+)(?:>|\Z)|[^<]+|<", re.S)
_ATTR = re.compile(r"""([^\s=>/][^\s=>/]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?""")
_NAMED = frozenset("class id role hidden style".split())
LEAF = len(TAGS)
LENGTHS = 8
WIDTH = 2 * (LEAF + 1) + len(HINTS) + 2 + LENGTHS + 6
RELATIONS = 3


class Page:
    """Nodes in page order: parent, sparse features, and the text of leaves."""

    __slots__ = ("parent", "feats", "texts", "depth", "truth")

    def __init__(self):
        self.parent, self.feats, self.texts, self.depth, self.truth = [], [], [], [], []


@lru_cache(maxsize=4096)
def _hints(attrs: str) -> tuple[int, ...]:
    words, out = [], []
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name not in _NAMED:
            continue
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            out.append(len(HINTS))
        elif name != "style":
            words.append(value)
    text = " ".join(words)
    return tuple(out + [i for i, h in enumerate(_HINTS) if h.search(text)])


_TAG = {t: i for i, t in enumerate(TAGS)}


def parse(source: str | None) -> Page:
    page = Page()
    stack: list[tuple[str, int]] = []  # open elements: name, node (that of the nearest block)
    base = 2 * (LEAF + 1)

    def node(tag: int, up: int, extra: tuple[int, ...]) -> int:
        page.parent.append(up)
        page.depth.append(page.depth[up] + 1 if up >= 0 else 0)
        above = page.feats[up][0] if up >= 0 else LEAF
        page.feats.append((tag, LEAF + 1 + above, *[base + e for e in extra]))
        page.texts.append(None)
        return len(page.parent) - 1

    root = node(_TAG["body"], -1, ())
    parts: list[str] = []
    linked = [0, 0]  # characters in links, in all
    links = skip = 0
    s = source or ""
    at, end = 0, len(s)

    def flush(up: int) -> None:
        if not parts:
            return
        text = "".join(parts)
        parts.clear()
        if "&" in text:
            text = html.unescape(text)
        text = " ".join(text.split())
        share = linked[0] / linked[1] if linked[1] else 0.0
        linked[:] = [0, 0]
        if not text:
            return
        n = len(text)
        extra = [len(HINTS) + 2 + min(LENGTHS - 1, n.bit_length() // 2)]
        k = len(HINTS) + 2 + LENGTHS
        if share > 0.5:
            extra.append(k)
        if text[-1] in ".!?\"'”»":
            extra.append(k + 1)
        if "©" in text or "copyright" in text.lower():
            extra.append(k + 2)
        if "|" in text or "·" in text:
            extra.append(k + 3)
        if text.count(" ") < 3:
            extra.append(k + 4)
        page.texts[node(LEAF, up, tuple(extra))] = text

    def here() -> int:
        return stack[-1][1] if stack else root

    def leave(i: int) -> None:
        nonlocal skip, links
        for gone, _ in stack[i:]:
            skip -= gone in SKIP
            links -= gone == "a"
        del stack[i:]

    def closed(name: str) -> bool:
        """Whether an end tag of the name follows: where there is none, the element is taken for one without content."""
        if name not in last:
            found = None
            for found in re.finditer(rf"</{re.escape(name)}[\s/>]", s, re.I):
                pass
            last[name] = found.start() if found else -1
        return last[name] >= at

    last: dict[str, int] = {}
    while at < end:
        m = _TOKEN.match(s, at)
        at = m.end()
        name = m.group(2)
        if name is None:
            t = m.group(0)
            if t[0] != "<" or t == "<":
                if not skip:
                    parts.append(t)
                    linked[1] += len(t)
                    if links:
                        linked[0] += len(t)
            continue
        name = name.lower()
        if m.group(1) and name != "br":  # an end tag
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if name in INLINE and any(x not in INLINE for x, _ in stack[i:]):
                        links -= name == "a"  # formatting that ends inside a block leaves the block open
                        del stack[i]
                        break
                    if any(x not in INLINE and x not in SKIP for x, _ in stack[i:]):
                        flush(here())
                    leave(i)
                    break
                if stack[i][0] in CLOSE_SCOPE.get(name, ()):
                    break
            else:
                if name == "p" and not skip:  # it ends nothing, but parts what stands around it
                    flush(here())
            continue
        if name == "br" or name == "hr":
            flush(here())
            continue
        if name in VOID or name in ("html", "head", "body"):
            continue
        if name in RAW:
            if closed(name):
                at = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(s, at).start()
                at = _TOKEN.match(s, at).end()
            elif name in ("script", "style"):
                at = end
            elif name in ("title", "textarea"):
                at = s.find("<", at) if s.find("<", at) >= 0 else end
            continue
        if skip and (name in CLOSES_P or name in SELF_CLOSE):  # a block ends controls; media only where a section begins
            for i, (x, _) in enumerate(stack):
                if x in CONTROLS and name not in CONTROLS or x in MEDIA and name in SECTIONS and x not in ("template", "svg"):
                    leave(i)
                    break
        if name in MEDIA and not closed(name):
            continue
        if not skip and name not in INLINE and name not in SKIP:
            flush(here())
            drop = None
            if name in CLOSES_P:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        drop = i
                        break
                    if stack[i][0] in SCOPE_END:
                        break
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in SELF_CLOSE.get(name, ()):
                    drop = i
                    break
                if stack[i][0] in SCOPE_END:
                    break
            if drop is not None:
                leave(drop)
        if m.group(3).rstrip().endswith("/") and name not in _TAG:
            continue
        skip += name in SKIP
        links += name == "a"
        if name in INLINE or skip:
            stack.append((name, here()))
        else:
            stack.append((name, node(_TAG.get(name, _TAG["div"]), here(), _hints(m.group(3)) if m.group(3) else ())))
    flush(here())
    return page


def _relation(page: Page) -> list[int]:
    base = 2 * (LEAF + 1)
    return [0 if f[0] == LEAF else 1 if len(f) == 2 or f[2] >= base + len(HINTS) else 2 for f in page.feats]


class Forest:
    """The nodes of many pages, as arrays."""

    def __init__(self, pages: list[Page]):
        start = np.cumsum([0, *(len(p.parent) for p in pages)])
        self.start = start
        self.parent = np.concatenate([np.array(p.parent) + (np.array(p.parent) >= 0) * s for p, s in zip(pages, start, strict=False)])
        self.depth = np.concatenate([np.array(p.depth) for p in pages])
        self.relation = np.concatenate([np.array(_relation(p)) for p in pages])
        feats = [f for p in pages for f in p.feats]
        self.row = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
        self.col = np.array([c for f in feats for c in f])
        self.levels = [np.flatnonzero(self.depth == d) for d in range(1, int(self.depth.max(initial=0)) + 1)]

    def marginals(self, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(content marginal of each node, joint with its parent): upward and downward sum-product messages."""
        n = len(self.parent)
        up = np.zeros((n, 2))
        up[:, 1] = np.bincount(self.row, unary[self.col], n)
        send = np.zeros((n, 2))
        for level in reversed(self.levels):
            m = np.logaddexp.reduce(up[level][:, None, :] + pair[self.relation[level]], axis=2)
            send[level] = m - m.max(1, keepdims=True)
            for k in range(2):
                np.add.at(up[:, k], self.parent[level], send[level, k])
        full = up.copy()
        joint = np.zeros((n, 2, 2))
        for level in self.levels:
            rest = full[self.parent[level]] - send[level]
            both = rest[:, :, None] + pair[self.relation[level]] + up[level][:, None, :]
            both -= np.logaddexp.reduce(both.reshape(len(level), 4), axis=1)[:, None, None]
            joint[level] = np.exp(both)
            full[level] = np.logaddexp.reduce(both, axis=1)
        p = 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -50, 50)))
        return p, joint


class Model:
    def __init__(self, unary: np.ndarray, pair: np.ndarray):
        self.unary, self.pair = unary, pair

    def texts(self, sources: list[str | None]) -> list[str]:
        pages = [parse(s) for s in sources]
        if not pages:
            return []
        forest = Forest(pages)
        p, _ = forest.marginals(self.unary, self.pair)
        return ["\n".join(t for t, x in zip(page.texts, p[a:b], strict=True) if t is not None and x >= 0.5) for page, a, b in zip(pages, forest.start, forest.start[1:], strict=False)]


FAMILIES = ("classed", "table", "renamed", "bare")
#: Pages without names are left out: what tells their advertisements is not there to be learned, and learning from them
#: costs other families.
TRAINED = (FAMILIES[0],) * 4 + FAMILIES[1:3]
_RENAMED = {"nav": ("menu-main", "site-nav"), "header": ("site-header", "masthead"), "footer": ("site-footer", "foot"), "aside": ("sidebar-right", "widget"), "article": ("post-content", "entry"), "main": ("main-content", "story-body"), "section": ("content-block", "text")}


def _as_family(page: str, family: str, pick) -> str:
    """The same page laid out by another habit: without names, in a table's cells, or with named divs only."""
    if family == "bare":
        return re.sub(r' (?:class|id)="[^"]*"', "", page)
    if family == "renamed":
        named = {t: pick(*names) for t, names in _RENAMED.items()}
        page = re.sub(r"<(nav|header|footer|aside|article|main|section)(?: (?:class|id)=\"([^\"]*)\")?>", lambda m: f'<div class="{m.group(2) or named[m.group(1)]}">', page)
        return re.sub(r"</(?:nav|header|footer|aside|article|main|section)>", "</div>", page)
    if family == "table":
        at = page.index("<body>") + 6
        return page[:at] + "<table><tr><td>" + re.sub(r"</?(?:main|article|section)>", "", page[at:].replace("<footer>", "</td></tr><tr><td><footer>"))
    return page


def labelled_pages(n: int = 300, seed: int = 9, families: tuple[str, ...] = FAMILIES[:1]):
    """Pages of varied layouts, families in turn; article text is told by a mark that training removes."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    words = ["".join(pick("ta", "ro", "in", "el", "us", "mi", "ko", "da", "en", "ist") for _ in range(rng.integers(1, 4))) for _ in range(400)]
    say = lambda a, b: " ".join(pick(*words) for _ in range(rng.integers(a, b)))
    sentence = lambda: say(2, 18).capitalize() + pick(".", ".", ".", "?", "!")
    prose = lambda a, b: " ".join(sentence() for _ in range(rng.integers(a, b)))
    plain = prose
    link = lambda: f'<a href="/{pick(*words)}">{say(1, 4)}</a>'
    cls = lambda *x: f' {pick("class", "class", "id")}="{pick(*x)}"'
    menu = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.integers(2, 8))) + "</ul>"

    def junk() -> str:
        return pick(
            lambda: f"<nav{pick('', cls('menu', 'topnav'))}>{menu()}</nav>",
            lambda: f"<div{cls('ad', 'ads', 'advert box', 'ad-slot', 'sponsored', 'banner')}>{prose(1, 3)}</div>",
            lambda: f"<aside{pick('', cls('sidebar', 'related'))}><h3>{say(1, 3)}</h3>{pick(menu(), '<p>' + prose(1, 3) + '</p>')}</aside>",
            lambda: f"<div{cls('sidebar', 'widget', 'related-posts', 'right-rail')}><h4>{say(1, 4)}</h4>{pick(menu(), '<p>' + prose(1, 4) + '</p>')}</div>",
            lambda: f"<div{cls('cookie-notice', 'consent', 'notice', 'newsletter', 'alert')}>{pick('<p>' + prose(1, 3) + '</p>', prose(1, 3))}</div>",
            lambda: f"<form{cls('search', 'signup', 'login')}><label>{say(1, 3)}</label><input name=q><button>{say(1, 2)}</button><p>{sentence()}</p></form>",
            lambda: f"<div{cls('breadcrumbs', 'navbar', 'pagination')}>{' | '.join(link() for _ in range(3))}</div>",
            lambda: f"<div{cls('share', 'social', 'tags')}>{menu()}</div>",
        )()

    def comments() -> str:
        one = lambda: f"<{pick('li', 'div', 'article')}{cls('comment', 'reply')}><p>{prose(1, 5)}</p></{pick('li', 'div')}>"
        return f"<{(t := pick('section', 'div'))}{cls('comments', 'comment-list', 'discussion', 'replies')}><h3>{say(1, 3)}</h3>{''.join(one() for _ in range(rng.integers(1, 5)))}</{t}>"

    def article() -> str:
        # an article may be a list of words, a table cut flat, or one word again and again; that doesn't make it a menu
        style = rng.random()
        flat = lambda a, b: " ".join(f"{say(1, 2)}{pick(' |', ' |', ' ·', '')}" for _ in range(3 * int(rng.integers(a, b + 4))))
        again = lambda a, b: " ".join([pick(*words)] * int(rng.integers(3, 30)))
        prose = flat if style < 0.2 else again if style < 0.3 else plain
        out = [f"<h1>\x01{say(2, 12) if style > 0.2 else prose(1, 2)[:60]}</h1>"]
        if rng.random() < 0.2:
            out.append(f"<p><b>\x01{prose(1, 3)}<br>")
        for _ in range(rng.integers(1, 12)):
            x = rng.random()
            out.append(
                f"<p>\x01{prose(1, 8)}</p>" if x < 0.5 else f"<p>\x01{say(1, 4).capitalize()}.</p>" if x < 0.6 else f"<p><b>\x01{prose(1, 3)}<br>" if x < 0.68
                else f"<p>\x01{prose(1, 3)} {link()} {prose(1, 3)}" if x < 0.76 else f"<h2>\x01{say(1, 8)}</h2>" if x < 0.82
                else "<ul>" + "".join(f"<li>\x01{say(2, 14)}</li>" for _ in range(rng.integers(2, 6))) + "</ul>" if x < 0.87
                else f"<blockquote>\x01{prose(1, 4)}</blockquote>" if x < 0.9 else f"<table><tr><td>\x01{say(1, 4)}</td><td>\x01{say(1, 4)}</td></tr></table>" if x < 0.92
                else f"<div>\x01{prose(1, 4)}</div>" if x < 0.95 else junk()
            )
        return "".join(out)

    for number in range(n):
        tag = pick("article", "article", "main", "section", "div")
        attrs = cls("content", "post", "entry-content", "article-body", "story", "main") if tag in ("div", "section") else pick("", cls("post", "content", "entry"))
        body = f"<{tag}{attrs}>{article()}</{tag}>"
        for _ in range(rng.integers(0, 3)):
            body = f"<div{pick('', cls('wrap', 'page', 'container', 'content', 'row'))}>{pick('', junk())}{body}{pick('', junk(), comments())}</div>"
        head = f"<header{pick('', cls('masthead', 'top'))}>{pick('', f'<h1>{say(1, 3)}</h1>', f'<p>{sentence()}</p>', f'<div>{link()}</div>')}{pick('', menu())}</header>" if rng.random() < 0.5 else ""
        foot = f"<footer>{pick('&copy; ', '', 'Copyright ')}{say(1, 4)} &middot; {pick(sentence(), link(), prose(1, 3))}</footer>" if rng.random() < 0.8 else f"<div{cls('footer', 'site-footer', 'copyright')}><p>&copy; {prose(1, 2)}</p></div>"
        page = f"<!DOCTYPE html><html><head><title>{say(2, 6)}</title><script>var x='<p>';</script></head><body>{head}{''.join(junk() for _ in range(rng.integers(0, 4)))}{body}{pick('', comments())}{''.join(junk() for _ in range(rng.integers(0, 3)))}{foot}" + pick("</body></html>", "")
        yield _as_family(page, families[number % len(families)], pick)


def _truth(page: Page) -> np.ndarray:
    """A leaf is content if it was marked, an element if most of the text below it is."""
    n = len(page.parent)
    own, all_ = np.zeros(n), np.zeros(n)
    for i in range(n - 1, -1, -1):
        t = page.texts[i]
        if t is not None:
            own[i], all_[i] = ("\x01" in t) * len(t), len(t)
        if page.parent[i] >= 0:
            own[page.parent[i]] += own[i]
            all_[page.parent[i]] += all_[i]
    return (own * 2 > all_).astype(np.int64)


@lru_cache(maxsize=2)
def train(pages: int = 600, rounds: int = 120, seed: int = 9, families: tuple[str, ...] = TRAINED) -> Model:
    """Fit on labelled pages by gradient ascent of the conditional likelihood."""
    made = [parse(s) for s in labelled_pages(pages, seed, families)]
    truth = np.concatenate([_truth(p) for p in made])
    f = Forest(made)
    child = np.flatnonzero(f.parent >= 0)
    seen = np.zeros((RELATIONS, 2, 2))
    np.add.at(seen, (f.relation[child], truth[f.parent[child]], truth[child]), 1)
    unary, pair = np.zeros(WIDTH), np.zeros((RELATIONS, 2, 2))
    su, sp = np.full(WIDTH, 1e-8), np.full(pair.shape, 1e-8)
    for _ in range(rounds):
        p, joint = f.marginals(unary, pair)
        gu = np.bincount(f.col, (truth - p)[f.row], WIDTH) - 0.3 * unary
        expect = np.zeros_like(pair)
        np.add.at(expect, f.relation[child], joint[child])
        gp = seen - expect - 0.3 * pair
        su += gu * gu
        sp += gp * gp
        unary = unary + 0.5 * gu / np.sqrt(su)
        pair = pair + 0.5 * gp / np.sqrt(sp)
    return Model(unary, pair)


def accuracy(model: Model, family: str, pages: int = 100, seed: int = 123) -> tuple[float, float]:
    """On unseen pages of a family: the share of pages extracted exactly, and F1 of text blocks."""
    exact = hit = found = true = 0
    for s in labelled_pages(pages, seed, (family,)):
        page = parse(s)
        want = [t.replace("\x01", "") for t in page.texts if t is not None and "\x01" in t]
        got = model.texts([s.replace("\x01", "")])[0]
        exact += got == "\n".join(want)
        blocks = got.split("\n") if got else []
        hit += sum((Counter(blocks) & Counter(want)).values())
        found, true = found + len(blocks), true + len(want)
    return exact / pages, 2 * hit / max(1, found + true)


def _extract(batches, model: Model, pages: int = 64):
    for batch in batches:
        sources = batch.column(2).to_pylist()
        texts = [t for i in range(0, len(sources), pages) for t in model.texts(sources[i : i + pages])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, model: Model | None = None, source: str = "html") -> DataFrame:
    """A row a page: page_id, url, text, n_chars."""
    spark = pages.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model or train())

    def task(batches):
        yield from tidy(_extract(batches, shared.value))

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col(source).alias("html")).mapInArrow(task, "page_id long, url string, text string, n_chars long")
