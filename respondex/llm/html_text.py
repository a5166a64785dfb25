"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of block elements whose leaves are runs of text.  Each node is
content or not.  A node's potential comes from its tag, words of its class and id, text
length, link share and ending; a parent and child share a potential for each pair of
labels.  Messages go up the tree and down again (sum-product); leaves whose marginal
is at least ``least`` are the text.

Potentials are fitted to labelled pages by gradient steps on their likelihood.  The pages
are GENERATED ones of known labels built by rule in many layouts, and at most SAMPLE of the
given ones that mark their article up (a classifier's documented bound): text in
``article`` or ``main``, but not in what marks inside it set apart, is content.

Null and empty pages have an empty text; pages of any length are read whole; repeated rows are each extracted; a marginal
equal to ``least`` counts as content; an empty table gives an empty result; only the named columns are read.
Elements that attributes hide (``hidden``, ``aria-hidden``, a style without display) have no text, whatever they hold.  Unclosed and
stray tags are mended as browsers do for paragraphs, list items and table cells; a broken
page never fails.  Formulas and the text inside drawings, media and objects are inline text.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respondex.llm.batches import map_rows

#: Pages built by rule; given pages to learn from at most, and their length; passes over them; step size.
GENERATED, SAMPLE, SAMPLE_CHARS, EPOCHS, RATE = 500, 100, 20_000, 12, 0.3
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe select textarea title".split())
#: Elements whose tags are all inline, whatever their names.
FOREIGN = frozenset(("math", "svg"))
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr input button acronym nobr math svg object video audio canvas source track param embed".split())
#: A start tag (or any block for p) that ends an open element of these names.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
APART = frozenset("nav footer aside form header menu dialog".split())
#: Words of tags, classes and ids that speak for or against content.
SIGNS = frozenset(
    "article content post entry main story body text page blog prose read markdown hentry lead paragraph nav navigation navbar menu header head "
    "masthead topbar footer foot bottom colophon sidebar side aside rail widget widgets ad ads advert advertisement adsense sponsor sponsored promo "
    "banner cookie cookies consent notice alert popup modal overlay newsletter subscribe signup form login search comment comments reply replies respond "
    "disqus discussion share social sharing related recommended more breadcrumb breadcrumbs pagination pager tags tag meta byline author copyright legal "
    "toolbar tools links list logo title headline caption figure".split()
)
#: Comments, declarations, tags; a tag with an unclosed quote ends at the next ``>``.
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
#: A name and, if there is one, its value: quoted in either way, or up to the next white space.
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_NONE = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_WORD = re.compile(r"[a-z]+")


def attributes(said: str) -> dict[str, str]:
    """Values by lower-cased name of the attributes of a tag (empty without one); of equal names the first counts."""
    out: dict[str, str] = {}
    for name, *value in _ATTR.findall(said):
        out.setdefault(name.lower(), html.unescape("".join(value)))
    return out


def hides(said: dict[str, str]) -> bool:
    """Whether attributes hide their element."""
    return "hidden" in said or said.get("aria-hidden", "").strip().lower() == "true" or bool(_NONE.search(said.get("style", "")))


def token(m: re.Match) -> tuple[str, str, str]:
    """``(slash of an end tag, lower-cased name, what follows it)``; no name for comments and declarations."""
    end, name, said = m.group(1, 2, 3) if m[2] else m.group(4, 5, 6)
    return end or "", (name or "").lower(), said or ""


def after_raw(source: str, name: str, at: int) -> int:
    """Where the text after an element without markup of its own goes on."""
    end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
    return end.end() if end else len(source)


def after_hidden(source: str, name: str, at: int, in_p: bool) -> int:
    """Where the text after a hidden inline element, whose start tag ends at ``at``, goes on.

    Elements nested in it are counted.  An unclosed one ends with its block: where an end tag closes what
    isn't open inside it, or a block begins in a paragraph.
    """
    open_names = [name]
    while m := _TOKEN.search(source, at):
        at = m.end()
        end, name, said = token(m)
        if not name:
            continue
        if end:
            if name in open_names:
                del open_names[len(open_names) - 1 - open_names[::-1].index(name) :]
                if not open_names:
                    return at
            elif name not in INLINE and name not in RAW:
                return m.start()
        elif name in RAW:
            at = after_raw(source, name, at)
        elif name not in VOID:
            if in_p and name not in INLINE and all(x in INLINE for x in open_names):
                return m.start()
            if not said.rstrip().endswith("/"):
                open_names.append(name)
    return len(source)


class Page:
    """Parallel lists of nodes in page order: parent, tag, signs, text (None: element), characters and link characters below."""

    def __init__(self, source: str):
        self.parent, self.tag, self.signs, self.text = [-1], ["#root"], [()], [None]
        self.chars, self.links = [0], [0]
        self.parse(source)
        for i in range(len(self.parent) - 1, 0, -1):
            self.chars[self.parent[i]] += self.chars[i]
            self.links[self.parent[i]] += self.links[i]

    def add(self, parent: int, tag: str, signs: tuple, text: str | None, links: int = 0) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.signs.append(signs)
        self.text.append(text)
        self.chars.append(len(text) if text else 0)
        self.links.append(links)
        return len(self.parent) - 1

    def parse(self, source: str) -> None:
        open_nodes, run, in_links, in_a, foreign = [0], [], 0, 0, 0

        def flush():
            nonlocal in_links
            if run:
                text = " ".join(html.unescape("".join(run)).split())
                if text:
                    at = open_nodes[-1]
                    self.add(at, self.tag[at], (), text, min(in_links, len(text)))
                run.clear()
            in_links = 0

        at, n = 0, len(source)
        while at < n:
            m = _TOKEN.search(source, at)
            piece = source[at : m.start() if m else n]
            if piece:
                run.append(piece)
                in_links += len(piece) if in_a else 0
            if not m:
                break
            at = m.end()
            end_tag, name, said = token(m)
            if not name:
                continue
            if m.start() < foreign and name not in RAW:
                continue
            if end_tag:
                if name == "a":
                    in_a = max(0, in_a - 1)
                elif name not in INLINE and name not in RAW:
                    depth = next((k for k in range(len(open_nodes) - 1, 0, -1) if self.tag[open_nodes[k]] == name), 0)
                    flush()
                    if depth:
                        del open_nodes[depth:]
                        in_a = 0
                continue
            closed = said.rstrip().endswith("/")
            if name in FOREIGN and not closed:
                end = re.compile(rf"</{name}\s*>", re.I).search(source, at)
                foreign = end.start() if end else at
            if name in RAW:
                at = after_raw(source, name, at)
                run.append(" ")
                continue
            has = attributes(said) if said else {}
            hidden = bool(has) and hides(has)
            if hidden and name in INLINE and name not in VOID and not closed:
                at = after_hidden(source, name, at, self.tag[open_nodes[-1]] == "p")
                continue
            if name == "a":
                in_a += not closed
                continue
            if name in INLINE:
                if name in ("br", "img", "wbr", "input"):
                    run.append(" " * (name != "wbr"))
                continue
            flush()
            if name in VOID:
                continue
            if self.tag[open_nodes[-1]] == "p":
                open_nodes.pop()
                in_a = 0
            ends = ENDS.get(name)
            if ends:
                k = len(open_nodes) - 1
                while k > 0 and self.tag[open_nodes[k]] not in ends and self.tag[open_nodes[k]] not in ("ul", "ol", "dl", "table"):
                    k -= 1
                if self.tag[open_nodes[k]] in ends:
                    del open_nodes[k:]
            names = [name, *_WORD.findall(" ".join(has.get(x, "") for x in ("class", "id", "role")).lower())]
            signs = tuple(dict.fromkeys(w for w in names if w in SIGNS)) + (("hidden",) if hidden else ())
            node = self.add(open_nodes[-1], name, signs, None)
            if not closed:
                open_nodes.append(node)
        flush()

    def features(self, i: int) -> list[str]:
        kind = "e" if self.text[i] is None else "l"
        n, text = self.chars[i], self.text[i]
        out = [f"{kind}t:{self.tag[i]}", f"{kind}n:{min(11, n.bit_length())}", f"{kind}d:{min(4, 5 * self.links[i] // n) if n else 5}"]
        out += [f"s:{w}" for w in self.signs[i]]
        if text is not None:
            out += [f"end:{text[-1] in '.!?…»”\"'}", f"c:{text[0] in '©®'}"]
        return out


def marked(page: Page) -> list[bool] | None:
    """Labels of a page that marks its article up; None for others."""
    n = len(page.parent)
    inside, apart = [False] * n, [False] * n
    for i in range(1, n):
        p = page.parent[i]
        el = page.text[i] is None
        inside[i] = inside[p] or el and page.tag[i] in ("article", "main")
        apart[i] = apart[p] or el and (page.tag[i] in APART or bool({"comment", "comments", "ad", "ads", "advert", "sidebar", "share", "hidden"} & set(page.signs[i])))
    return spread(page, [inside[i] and not apart[i] for i in range(n)]) if any(inside) else None


def spread(page: Page, leaf: list[bool]) -> list[bool]:
    """Labels of all nodes from those of leaves: an element is content if most of its text is."""
    good = [page.chars[i] if page.text[i] is not None and leaf[i] else 0 for i in range(len(leaf))]
    for i in range(len(leaf) - 1, 0, -1):
        good[page.parent[i]] += good[i]
    return [leaf[i] if page.text[i] is not None else 2 * good[i] > page.chars[i] for i in range(len(leaf))]


def generated(seed: int) -> tuple[str, list[str]]:
    """A page in a layout chosen by ``seed``, and its content blocks."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeiou") + r.choice("bcdlmnrst") for _ in range(r.randint(1, 4)))
    line = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize()
    links = lambda n: "".join(f'<li><a href="/{word()}">{line(1, 3)}</a></li>' for _ in range(n))
    wrap = lambda tag, cls, x: f'<{tag} {r.choice(["class", "id"])}="{cls}">{x}</{tag}>'
    blocks, inner = [], []
    for k in range(r.randint(1, 12)):
        short = r.random() < 0.25
        text = line(1, 6) if short else line(12, 90)
        tag = "h1" if k == 0 and r.random() < 0.7 else r.choice(["h2", "h3", "p"]) if short else r.choice(["p", "p", "p", "p", "blockquote", "div", "li"])
        text += "." if tag in ("p", "blockquote", "div") and r.random() < 0.9 else ""
        blocks.append(text)
        words = text.split(" ")
        if len(words) > 20 and r.random() < 0.4:
            words[5] = f'<a href="#">{words[5]}</a>'
        inner.append(f"<ul><li>{' '.join(words)}</li></ul>" if tag == "li" else f"<{tag}>{' '.join(words)}</{tag}>")
        if r.random() < 0.08:
            inner.append(wrap("div", r.choice(["ad", "advert", "share social", "related", "newsletter"]), line(2, 8)))
    article = "".join(inner)
    holder = r.choice(["article", "main", "div", "section", "div", "td"])
    cls = r.choice(["content", "post", "entry-content", "article-body", "main", "story", "c1", "page-text", "wrap"])
    article = "<article>" + article + "</article>" if holder == "article" and r.random() < 0.5 else wrap("div" if holder == "td" else holder, cls, article)
    if r.random() < 0.3:
        article = wrap("div", r.choice(["container", "wrapper", "row"]), article)
    before = [r.choice([f"<nav><ul>{links(5)}</ul></nav>", wrap("div", "menu", f"<ul>{links(6)}</ul>"), wrap("ul", "navbar", links(4))])]
    if r.random() < 0.6:
        before.insert(0, r.choice([f"<header><h2>{line(1, 3)}</h2><p>{line(3, 9)}</p></header>", wrap("div", "header", line(2, 6)), wrap("div", "masthead", f"<p>{line(2, 9)}</p>")]))
    if r.random() < 0.5:
        before.append(wrap("div", r.choice(["ad", "ads", "banner", "cookie-notice", "alert", "cookie-consent", "sponsored"]), r.choice(["", "<p>"]) + line(3, 30) + "."))
    after = []
    if r.random() < 0.5:
        after.append(r.choice([f"<aside><h3>{line(1, 3)}</h3><p>{line(5, 40)}.</p></aside>", wrap("div", "sidebar", f"<h3>{line(1, 2)}</h3><ul>{links(5)}</ul><p>{line(6, 30)}.</p>")]))
    if r.random() < 0.5:
        said = "".join(wrap("div", "comment", f"<p>{line(4, 40)}.</p>") for _ in range(r.randint(1, 5)))
        after.append(wrap(r.choice(["section", "div", "ol"]), r.choice(["comments", "comment-list", "replies", "disqus"]), f"<h3>{line(1, 2)}</h3>{said}"))
    if r.random() < 0.4:
        after.append(f'<form action="/s"><p>{line(2, 12)}</p><label>{line(1, 3)}</label><input name="q"><button>{line(1, 1)}</button></form>')
    if r.random() < 0.3:
        after.append(wrap("div", "related", f"<h3>{line(1, 2)}</h3><ul>{links(4)}</ul>"))
    after.append(r.choice([f"<footer>&copy; {word()} &middot; {line(3, 14)}.</footer>", wrap("div", "footer", f"<p>&copy; {line(3, 14)}.</p>"), f"<footer><p>{line(4, 12)}.</p><ul>{links(3)}</ul></footer>"]))
    if r.random() < 0.2:
        before.append(after.pop(0))
    return "<html><head><title>" + line(2, 6) + "</title></head><body>" + "".join(before) + article + "".join(after) + "</body></html>", blocks


def through(x: float, a: float, b: float, c: float, d: float) -> float:
    """log of (a + b e^x) / (c + d e^x)."""
    if x > 0:
        y = exp(-min(x, 500.0))
        return log((a * y + b) / (c * y + d))
    y = exp(max(x, -500.0))
    return log((a + b * y) / (c + d * y))


def sigmoid(x: float) -> float:
    return 1 / (1 + exp(-max(-500.0, min(500.0, x))))


class Model:
    """Log-potentials: ``odds`` of features for content, ``pair`` of kind, parent's and child's label."""

    def __init__(self, odds: dict[str, float] | None = None, pair: dict[str, list[list[float]]] | None = None):
        self.odds = odds if odds is not None else {}
        self.pair = pair if pair is not None else {k: [[0.5, -0.5], [-0.5, 0.5]] for k in ("e", "l")}

    def messages(self, page: Page, features: list[list[str]]) -> tuple[list[float], list[float], list[float]]:
        """(belief, up, told): log-ratios of content for each node, from below and itself, and as told to its parent."""
        n, get = len(page.parent), self.odds.get
        up, told = [sum(get(f, 0.0) for f in x) for x in features], [0.0] * n
        tables = {k: [[exp(v) for v in row] for row in t] for k, t in self.pair.items()}
        kinds = [tables["e" if t is None else "l"] for t in page.text]
        for i in range(n - 1, 0, -1):
            k = kinds[i]
            told[i] = through(up[i], k[1][0], k[1][1], k[0][0], k[0][1])
            up[page.parent[i]] += told[i]
        belief = up[:]
        for i in range(1, n):
            k, p = kinds[i], page.parent[i]
            belief[i] += through(belief[p] - told[i], k[0][1], k[1][1], k[0][0], k[1][0])
        return belief, up, told

    def marginals(self, page: Page) -> list[float]:
        """Chance of content for each node, by messages up and down the tree."""
        return [sigmoid(b) for b in self.messages(page, [[]] + [page.features(i) for i in range(1, len(page.parent))])[0]]

    def train(self, pages: list[tuple[Page, list[bool]]]) -> None:
        """Raise the likelihood of labels by steps along observed less expected counts of features and of label pairs."""
        ready = [(page, labels, [[]] + [page.features(i) for i in range(1, len(labels))]) for page, labels in pages]
        size: dict = {}

        def move(table, key, g: float, name) -> None:
            size[name] = size.get(name, 1e-3) + g * g
            table[key] = 0.9995 * (table.get(key, 0.0) if isinstance(table, dict) else table[key]) + RATE * g / size[name] ** 0.5

        rng = random.Random(11)
        for _ in range(EPOCHS):
            rng.shuffle(ready)
            for page, labels, features in ready:
                belief, up, told = self.messages(page, features)
                change: Counter = Counter()
                pairs: Counter = Counter()
                for i in range(1, len(labels)):
                    off = labels[i] - sigmoid(belief[i])
                    for f in features[i]:
                        change[f] += off
                    kind, p = "e" if page.text[i] is None else "l", page.parent[i]
                    v, cavity = self.pair[kind], belief[p] - told[i]
                    raw = [v[a][c] + a * cavity + c * up[i] for a in (0, 1) for c in (0, 1)]
                    top = max(raw)
                    raw = [exp(x - top) for x in raw]
                    for j, x in enumerate(raw):
                        pairs[kind, j] += (j == 2 * labels[p] + labels[i]) - x / sum(raw)
                scale = 1 / len(labels) ** 0.5
                for f, g in change.items():
                    move(self.odds, f, g * scale, f)
                for (kind, j), g in pairs.items():
                    move(self.pair[kind][j // 2], j % 2, g * scale, (kind, j))

    def text(self, source: str | None, least: float = 0.5) -> str:
        if not source:
            return ""
        page = Page(source)
        chance, hidden = self.marginals(page), [False]
        for parent, signs in zip(page.parent[1:], page.signs[1:], strict=True):
            hidden.append(hidden[parent] or "hidden" in signs)
        return "\n\n".join(t for t, c, h in zip(page.text, chance, hidden, strict=True) if t is not None and c >= least and not h)


def learn(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> Model:
    """Fitted potentials; the sample is of marked-up pages of at most SAMPLE_CHARS characters, least hashes of the id first."""
    given = pages.where(F.col(html_col).rlike("(?i)<(article|main)[ >]") & (F.length(html_col) <= SAMPLE_CHARS))
    # only ids meet in the top-k; the pages of those chosen are then read
    ids = [r[0] for r in given.where(F.col(id_col).isNotNull()).select(id_col).distinct().orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(sample).collect()]
    rows = given.where(F.col(id_col).isin(ids)).select(F.col(html_col).alias("h")).collect() if ids else []
    return fitted(sorted(r["h"] for r in rows)[: 2 * sample])


def fitted(sources: list[str]) -> Model:
    """Potentials from marked-up pages and the generated ones."""
    train = []
    for source in sources:
        page = Page(source)
        labels = marked(page)
        if labels:
            train.append((page, labels))
    for seed in range(GENERATED):
        source, blocks = generated(seed)
        page, left = Page(source), set(blocks)
        train.append((page, spread(page, [t is not None and t in left for t in page.text])))
    model = Model()
    model.train(train)
    return model


def extracted(pages: DataFrame, model: Model, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns and ``text`` of every row."""
    sent = pages.sparkSession.sparkContext.broadcast((model.odds, model.pair))
    rows = pages.select(*keep, F.col(html_col).cast("string").alias("h"))

    def make():
        model = Model(*sent.value)
        return lambda batch: {c: batch.column(c) for c in keep} | {"text": [model.text(x) for x in batch.column("h").to_pylist()]}

    kind = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep) + ", text string"
    return map_rows(rows, kind, "h", make)


def op7(spark, sf_dir: str) -> DataFrame:
    """Contract query: main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extracted(pages, learn(pages)).withColumn("n_chars", F.length("text").cast("long"))
