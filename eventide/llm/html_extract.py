"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: runs of text that no block-level tag interrupts.  Each has
features of its ancestors' tags, their class, id and role words, and of its text.  A chain model
with one weight per feature and one per pair of neighbouring labels, trained on the labelled
pages of ``training_pages``, labels the blocks; Viterbi decoding picks the best sequence.
"""

from __future__ import annotations

import html
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, table

# Element names with a meaning of their own in the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript svg math iframe object audio video canvas datalist".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
#: A start tag ends open elements of these names, up to an element of the second set.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}

#: Start tags that may stand in a head; any other, or text, ends an open one.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())

SCOPES = frozenset("article main nav aside header footer form section td body".split())

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: Where a tag's attributes end, or a quoted value begins.
_STOP = re.compile(r"""=\s*(["'])|>""")
_MARK = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]{2,}")
#: Zeros before a numeric reference's number, and numbers beyond any character.
_ZEROS, _HUGE = re.compile(r"&#([xX]?)0+(?=[0-9a-fA-F])"), re.compile(r"&#(?:[xX][0-9a-fA-F]{7,}|[0-9]{8,});?")

PAGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _marks(attributes: str) -> tuple[str, ...]:
    """Words of class, id, role and itemprop; 'hidden' if the element is."""
    out = []
    for name, a, b, c in _MARK.findall(attributes):
        value, name = (a or b or c).lower(), name.lower()
        if name == "style":
            out += ["hidden"] * bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
        elif name == "hidden" or name == "aria-hidden":
            out += ["hidden"] * (value != "false")
        else:
            out += _WORD.findall(value)
    return tuple(out)


class Element:
    """An open element: its name and marks with those of all elements around it, as far as ``known`` has their features."""

    __slots__ = ("inner", "marks", "name", "parent", "scope", "tags")

    def __init__(self, name: str, marks: tuple[str, ...], around: Element | None, known: dict | None):
        self.name = name
        tags, held = (around.tags, around.marks) if around else (frozenset(), frozenset())
        new = {m for m in marks if m not in held and (known is None or f"c:{m}" in known)}
        self.marks = held | new if new else held
        self.tags = tags if name in tags or known is not None and f"t:{name}" not in known else tags | {name}
        inline = name in INLINE
        self.parent = (around.parent if around else "") if inline else name
        self.scope = name if name in SCOPES else around.scope if around else ""
        #: How many of it and the elements around it are no inline elements.
        self.inner = (around.inner if around else 0) + (not inline)


#: What stands around all elements of a page.
_PAGE = Element("", (), None, {})


class Block:
    __slots__ = ("linked", "marks", "parent", "scope", "tags", "text")

    def __init__(self, text: str, inside: Element, linked: int):
        self.text, self.linked = text, linked
        self.tags, self.marks, self.parent, self.scope = inside.tags, inside.marks, inside.parent, inside.scope


def _decoded(text: str) -> str:
    """Character references decoded and white space folded."""
    if "&#" in text:
        text = _HUGE.sub("\ufffd", _ZEROS.sub(r"&#\1", text))
    return " ".join(html.unescape(text).split())


class _Tags:
    """Finds the tags of a page from left to right.

    Every character is passed a bounded number of times.  A quoted value that is never closed ends its tag
    at the next '>'; where there is none, '<' is text.
    """

    def __init__(self, page: str):
        self.page, self.closed = page, True
        #: Places of quotation marks from which no tag ends.
        self.open_quotes: set[int] = set()

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """The next one from ``at`` on: (start, end, closing, name, attributes); comments have no name."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith(("<!--", "<![CDATA[", "<!", "<?"), start):
                mark, size = ("-->", 4) if page.startswith("--", start + 2) else ("]]>", 9) if page.startswith("[CDATA[", start + 2) else (">", 2)
                end = page.find(mark, start + size)
                return start, end + len(mark) if end >= 0 else len(page), False, "", ""
            first = page.find(">", start) if self.closed else -1
            self.closed = first >= 0
            if self.closed and (found := _NAME.match(page, start)):
                end = self._end(found.end(), first)
                return start, end + 1, bool(found[1]), found[2].lower(), page[found.end() : end]
            at = start + 1
        return None

    def _end(self, at: int, first: int) -> int:
        """Where the tag's '>' stands: the first one outside of quoted values, else the ``first`` of all."""
        passed = []
        while True:
            stop = _STOP.search(self.page, at)
            if not stop:
                break
            if not stop[1]:
                return stop.start()
            quote = stop.end() - 1
            if quote in self.open_quotes:
                break
            passed.append(quote)
            close = self.page.find(stop[1], quote + 1)
            if close < 0:
                break
            at = close + 1
        self.open_quotes.update(passed)
        return first


def leaf_blocks(page: str, known: dict | None = None) -> list[Block]:
    """The blocks of a page in order, with character references decoded and white space folded.

    ``known`` are the names of the features that matter; all do by default.  Time grows with the page's length,
    however its elements nest or stay open.
    """
    blocks: list[Block] = []
    stack: list[Element] = [_PAGE]
    places: dict[str, list[int]] = {}
    parts: list[str] = []
    links: list[str] = []
    links_open = unseen = at = 0
    held = _PAGE

    def flush():
        if parts:
            text = _decoded("".join(parts))
            if text:
                blocks.append(Block(text, held, len(_decoded("".join(links)))))
            parts.clear()
            links.clear()

    def add(text: str):
        nonlocal held
        if stack[-1].name == "head" and text.strip(" \t\n\f\r"):
            shut(len(stack) - 1)
        if text and not unseen:
            if not parts:
                held = stack[-1]
            parts.append(text)
            if links_open:
                links.append(text)

    def shut(depth: int):
        nonlocal unseen, links_open
        while len(stack) > depth:
            name = stack.pop().name
            places[name].pop()
            unseen -= name in UNSEEN
            links_open -= name == "a"

    def deepest(names) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    tags = _Tags(page)
    while tag := tags.after(at):
        start, end, closing, name, attributes = tag
        add(page[at:start])
        at = end
        if not name:
            continue
        if name not in INLINE:
            flush()
        if closing:
            if places.get(name):
                shut(places[name][-1])
            continue
        if stack[-1].name == "head" and name not in IN_HEAD:
            shut(len(stack) - 1)
        if name == "br":
            add(" ")
        if name in CLOSES_P and (p := deepest(("p",))) and stack[-1].inner == stack[p].inner:
            shut(p)
        if name in SIBLINGS:
            ends, bounds = SIBLINGS[name]
            bound = deepest(bounds)
            while (depth := deepest(ends)) > bound:
                shut(depth)
        if name in VOID or attributes.rstrip().endswith("/") and name not in INLINE and name not in CLOSES_P:
            continue
        places.setdefault(name, []).append(len(stack))
        stack.append(Element(name, _marks(attributes), stack[-1], known))
        unseen += name in UNSEEN
        links_open += name == "a"
        if name in RAW:
            last = re.compile(rf"</{name}\s*/?>", re.I).search(page, at)
            if name == "textarea" and not unseen:
                add(page[at : last.start() if last else len(page)])
                flush()
            at = last.end() if last else len(page)
            shut(len(stack) - 1)
    add(page[at:])
    flush()
    return blocks


def features(block: Block, number: int) -> list[str]:
    """Names of a block's features."""
    text, words = block.text, block.text.count(" ") + 1
    out = [f"t:{t}" for t in block.tags] + [f"c:{m}" for m in block.marks]
    out.append(f"p:{block.parent}")
    out.append(f"scope:{block.scope}")
    out.append(f"words:{min(6, words.bit_length())}")
    out.append(f"links:{min(3, 4 * block.linked // max(1, len(text)))}")
    out.append(f"stops:{min(3, sum(map(text.count, '.!?')))}")
    out.append(f"commas:{min(2, text.count(','))}")
    if text[-1] in ".!?:\"'”»":
        out.append("ended")
    if text[0] in "©" or text.startswith("Copyright"):
        out.append("copyright")
    if sum(map(str.isdigit, text)) * 4 > len(text):
        out.append("numbers")
    if number == 0:
        out.append("first")
    return out


# ---- labelled pages -------------------------------------------------------------------------


def _sentence(r: random.Random, low: int, high: int) -> str:
    words = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
    text = " ".join(w + "," * (r.random() < 0.06) for w in words).strip(",")
    return text.capitalize() + r.choice(".....!?")


def _prose(r: random.Random, high: int = 6) -> str:
    return " ".join(_sentence(r, 1, 22) for _ in range(r.randint(1, high)))


def _some(r: random.Random, names: str) -> str:
    return r.choice(names.split())


def _links(r: random.Random, n: int) -> str:
    return "".join(f'<li><a href="/{i}">{_sentence(r, 1, 3)[:-1]}</a></li>' for i in range(n))


def _chrome(r: random.Random, kind: str) -> str:
    """HTML of one part of a page that is not its main text."""
    text = _prose(r, 2)
    if kind == "menu":
        inner = f"<ul>{_links(r, r.randint(2, 8))}</ul>"
        return r.choice([f"<nav>{inner}</nav>", f'<div class="{_some(r, "menu navbar nav navigation breadcrumb breadcrumbs pagination pager toolbar")}">{inner}</div>', f'<ul id="{_some(r, "menu nav topnav")}">{_links(r, 5)}</ul>'])
    if kind == "head":
        inner = f"<h1>{_sentence(r, 1, 4)[:-1]}</h1><p>{text}</p>" if r.random() < 0.5 else f"<p>{text}</p>"
        return r.choice([f"<header>{inner}</header>", f'<div class="{_some(r, "header masthead topbar site-header branding logo")}">{inner}</div>', f'<div id="header">{inner}</div>'])
    if kind == "side":
        inner = f"<h3>{_sentence(r, 1, 3)[:-1]}</h3><p>{text}</p>" + (f"<ul>{_links(r, 4)}</ul>" if r.random() < 0.6 else "")
        return r.choice([f"<aside>{inner}</aside>", f'<div class="{_some(r, "sidebar widget related recommended popular trending more-stories rail side social share sharing tags")}">{inner}</div>', f'<div id="sidebar">{inner}</div>'])
    if kind == "notice":
        name = _some(r, "cookie cookie-banner notice alert consent gdpr popup modal overlay banner message warning disclaimer subscribe paywall")
        return f'<div class="{name}"><p>{text}</p></div>' if r.random() < 0.6 else f'<div {r.choice(["id", "class", "role"])}="{name}">{text}</div>'
    if kind == "advert":
        name = _some(r, "ad ads advert advertisement sponsored sponsor promo promotion adbox ad-slot commercial")
        return r.choice([f'<div class="{name}">{text}</div>', f'<div class="{name}"><p>{text}</p></div>', f'<div id="{name}"><a href="/x">{text}</a></div>', f'<section class="{name}">{text}</section>'])
    if kind == "form":
        inner = f"<label>{_sentence(r, 1, 4)[:-1]}</label><input name=q><select><option>{_sentence(r, 1, 2)}<option>{_sentence(r, 1, 2)}</select><p>{text}</p><button>{_sentence(r, 1, 2)[:-1]}</button>"
        return f'<form class="{_some(r, "search login newsletter signup contact")}">{inner}</form>' if r.random() < 0.7 else f"<form>{inner}</form>"
    if kind == "comments":
        name = _some(r, "comment comments reply replies discussion responses disqus")
        inner = "".join(f'<div class="{name}"><b>{_sentence(r, 1, 2)[:-1]}</b><p>{_prose(r, 4)}</p></div>' if r.random() < 0.6 else f"<li><p>{_prose(r, 4)}</p></li>" for _ in range(r.randint(1, 4)))
        return f'<{(t := _some(r, "section div ol"))} {r.choice(["id", "class"])}="{name}"><h2>{_sentence(r, 1, 2)[:-1]}</h2>{inner}</{t}>'
    inner = r.choice(["&copy; 2020 " + _sentence(r, 1, 4), text, f"<p>&copy; {_sentence(r, 2, 6)}</p><ul>{_links(r, 3)}</ul>", f"<p>{text}</p>"])
    return r.choice([f"<footer>{inner}</footer>", f'<div class="{_some(r, "footer copyright legal site-footer colophon bottom")}">{inner}</div>', f'<div id="footer">{inner}</div>'])


def _article(r: random.Random) -> str:
    out = [f"<{(h := _some(r, 'h1 h1 h2'))}>{_sentence(r, 1, 12)[:-1]}</{h}>"] if r.random() < 0.85 else []
    for _ in range(r.randint(1, 9)):
        body, x = _prose(r), r.random()
        body = body if r.random() < 0.8 else body[: r.randint(1, len(body))].strip() or body
        if x < 0.62:
            out.append(f"<p>{body}</p>")
        elif x < 0.7:
            out.append(f"<p><b>{body}<br><p>{_prose(r)}</p>")
        elif x < 0.76:
            out.append(f"<p>{body} <a href=/x>{_sentence(r, 1, 5)}</a> {_sentence(r, 1, 9)}</p>")
        elif x < 0.81:
            out.append("<ul>" + "".join(f"<li>{_sentence(r, 1, 12)}</li>" for _ in range(r.randint(1, 4))) + "</ul>")
        elif x < 0.86:
            out.append(f"<h2>{_sentence(r, 1, 6)[:-1]}</h2><p>{body}</p>")
        elif x < 0.89:
            out.append(f"<blockquote>{body}</blockquote>")
        elif x < 0.92:
            out.append(f"<table><tr><td>{_sentence(r, 1, 3)}<td>{_sentence(r, 1, 3)}</table>")
        elif x < 0.95:
            out.append(f"<pre>{body}</pre>")
        else:
            out.append(f"<div>{body}</div>")
    return "".join(out)


def training_pages(n: int = 700, seed: int = 7) -> list[tuple[str, list[bool]]]:
    """Labelled pages: HTML and, for each of its leaf blocks, whether it is main text.

    Pages are built from parts that are known to be main text or not; a private element around
    main parts labels their blocks and is then taken out of the page.
    """
    r, out = random.Random(seed), []
    for _ in range(n):
        kinds = "menu head side notice advert form comments".split()
        before = [_chrome(r, k) for k in ("menu", "head", "notice", "advert", "side", "form") if r.random() < 0.45]
        after = [_chrome(r, r.choice(kinds)) for _ in range(r.randint(0, 3))]
        after += [_chrome(r, "comments")] * (r.random() < 0.4) + [_chrome(r, "foot")] * (r.random() < 0.85)
        r.shuffle(before)
        body = _article(r)
        inside = [_chrome(r, r.choice("advert side notice form comments menu".split())) for _ in range(r.choice([0, 0, 1, 2]))]
        pieces = [f"<zzmain>{p}</zzmain>" for p in ([body] if not inside else [body, _article(r)])]
        for x in inside:
            pieces.insert(r.randint(0, len(pieces)), x)
        name = _some(r, "article article article article main main section div div td")
        mark = r.choice(["", "", 'class="content"', 'id="content"', 'class="post-body"', 'class="article-body"', 'class="entry-content"', 'class="story"', 'id="main"', 'role="main"', 'class="text"', 'itemprop="articleBody"'])
        main = f"<{name} {mark}>{''.join(pieces)}</{name}>" if name != "td" else f"<table><tr><td {mark}>{''.join(pieces)}</td></tr></table>"
        if r.random() < 0.3:
            main = f'<div {r.choice(["id", "class"])}="{_some(r, "wrapper page container site row")}">{main}</div>'
        page = f"<html><head><title>{_sentence(r, 2, 6)}</title><script>x('</p>')</script></head><body>{''.join(before)}{main}{''.join(after)}</body></html>"
        labels = ["zzmain" in b.tags for b in leaf_blocks(page)]
        page = re.sub("</?zzmain>", "", page)
        if len(leaf_blocks(page)) == len(labels):
            out.append((page, labels))
    return out


class ChainField:
    """A chain of labels 0 (not main) and 1 (main)."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, links: np.ndarray):
        self.names, self.weights, self.links = names, weights, links
        self.plain = {n: float(weights[i]) for n, i in names.items()}

    def label(self, blocks: list[Block]) -> list[bool]:
        """Viterbi decoding."""
        if not blocks:
            return []
        get = self.plain.get
        (a00, a01), (a10, a11) = self.links.tolist()
        low = high = None
        back = []
        for i, b in enumerate(blocks):
            x = sum(get(f, 0.0) for f in features(b, i))
            if low is None:
                low, high = 0.0, x
                continue
            to_low, to_high = high + a10 > low + a00, high + a11 >= low + a01
            back.append((to_low, to_high))
            low, high = max(low + a00, high + a10), max(low + a01, high + a11) + x
        out = [high > low]
        for pair in reversed(back):
            out.append(pair[out[-1]])
        return out[::-1]

    def extract(self, page: str) -> str:
        blocks = leaf_blocks(page, self.plain)
        return " ".join(b.text for b, main in zip(blocks, self.label(blocks), strict=True) if main)


def train(pages: list[tuple[str, list[bool]]], rounds: int = 250, ridge: float = 0.004, rate: float = 0.1) -> ChainField:
    """Maximum likelihood with a ridge by Adam steps; all pages go through forward-backward together."""
    read = [(leaf_blocks(p), y) for p, y in pages]
    read = [([features(b, i) for i, b in enumerate(bs)], y) for bs, y in read if bs]
    seen: dict[str, int] = {}
    for fs, _ in read:
        for f in {x for row in fs for x in row}:
            seen[f] = seen.get(f, 0) + 1
    names = {f: i for i, f in enumerate(sorted(f for f, c in seen.items() if c > 1))}
    most, n = max(len(fs) for fs, _ in read), len(read)
    x = np.zeros((n, most, len(names)), np.float32)
    y, mask = np.zeros((n, most), int), np.zeros((n, most), bool)
    for i, (fs, labels) in enumerate(read):
        mask[i, : len(fs)] = True
        y[i, : len(fs)] = labels
        for t, row in enumerate(fs):
            x[i, t, [names[f] for f in row if f in names]] = 1
    weights, links = np.zeros(len(names)), np.zeros((2, 2))
    moments = [np.zeros(len(names) + 4), np.zeros(len(names) + 4)]
    for step in range(1, rounds + 1):
        _, grad, pair = likelihood(x, y, mask, weights, links)
        g = np.concatenate([grad - ridge * n / 10 * weights, (pair - ridge * links).ravel()]) / n
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.99 * moments[1] + 0.01 * g * g
        move = rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        weights = weights + move[:-4]
        links = links + move[-4:].reshape(2, 2)
    return ChainField(names, weights, links)


def likelihood(x: np.ndarray, y: np.ndarray, mask: np.ndarray, weights: np.ndarray, links: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of the labels y of all chains, and its gradients by weights and by links.

    ``x`` has the features of each page's blocks, ``mask`` tells which blocks there are.
    """
    n, most = mask.shape
    both = mask[:, 1:]
    s = np.zeros((n, most, 2))
    s[..., 1] = x @ weights
    forward, backward = np.zeros_like(s), np.zeros_like(s)
    forward[:, 0] = s[:, 0]
    for t in range(1, most):
        new = np.logaddexp(forward[:, t - 1, :1] + links[0], forward[:, t - 1, 1:] + links[1]) + s[:, t]
        forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
    for t in range(most - 2, -1, -1):
        v = s[:, t + 1] + backward[:, t + 1]
        new = np.stack([np.logaddexp(links[a, 0] + v[:, 0], links[a, 1] + v[:, 1]) for a in (0, 1)], 1)
        backward[:, t] = np.where(mask[:, t + 1, None], new, backward[:, t])
    whole = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
    p = np.exp(forward[..., 1] + backward[..., 1] - whole[:, None]) * mask
    pair, gold = np.zeros((2, 2)), np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            gold[a, b] = ((y[:, :-1] == a) & (y[:, 1:] == b) & both).sum()
            z = forward[:, :-1, a] + links[a, b] + s[:, 1:, b] + backward[:, 1:, b] - whole[:, None]
            pair[a, b] = np.exp(np.where(both, z, -np.inf)).sum()
    value = float((s[..., 1] * y * mask).sum() + (gold * links).sum() - whole.sum())
    return value, np.einsum("nt,ntf->f", y * mask - p, x), gold - pair


@lru_cache(1)
def default_field() -> ChainField:
    """The field trained on ``training_pages``; its size doesn't depend on the data it is used on."""
    return train(training_pages())


def extract_pages(pages: DataFrame, field: ChainField | None = None) -> DataFrame:
    """One row for each row of ``pages``: page_id, url, text, n_chars (code points).

    A null or empty page has the text ''.  Nothing is dropped or capped; repeated rows repeat.  Bytes that are
    no UTF-8 become U+FFFD.  Time is proportional to the length of a page, whatever it holds.
    An empty table gives no rows; of the columns only page_id, url and html are read, so others may have any names.
    """
    shared = pages.sparkSession.sparkContext.broadcast(field or default_field())

    def run(_, ids, urls, pages):
        texts = [shared.value.extract(p.decode("utf-8", "replace")) for p in pages]
        return {"page_id": ids, "url": urls, "text": texts, "n_chars": [len(t) for t in texts]}

    return map_texts(pages, run, PAGES, keys=["page_id", "url"], text="html")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
