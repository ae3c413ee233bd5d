"""Main text of web pages by boosted trees over DOM nodes and hierarchical decoding (operator 6).

A page is read into a tree of block elements; text between two block borders is a leaf. Each node has features of its own and of
its place: tag, attribute words, depth, text and link density of its subtree, and how it stands among its siblings. Boosted trees
give the odds that a node holds main text. A node may hold main text only if its parent does, so the labels of a page are chosen
together: the likeliest of all labellings that obey this, by dynamic programming over the tree.

The trees are trained here on TRAIN_PAGES generated pages (bounded; a parameter) whose main text is known.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import bounded_batches, table

TRAIN_PAGES, SEED = 240, 11

# Element names by how HTML treats them, and attribute words with what they tend to hold.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
IN_PARAGRAPH = INLINE | frozenset("br img input button wbr object audio video canvas map picture source".split())
PEERS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDERS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
CONTROLS = frozenset("input button textarea select option".split())
TAGS = "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dd table tr td pre blockquote figure figcaption nav header footer aside form fieldset button details address center #text".split()
GOOD_WORDS = "article content main post entry story body text page hentry blog copy prose".split()
BAD_WORDS = "nav menu header masthead banner footer foot copyright legal sidebar aside side widget ad ads advert advertisement sponsor sponsored promo cookie cookies consent notice gdpr alert popup modal newsletter subscribe signup login search share social related recommended more breadcrumb breadcrumbs pagination pager toolbar tags meta byline comment comments reply replies respond discussion disqus form skip".split()
_WORDS = frozenset(GOOD_WORDS + BAD_WORDS)
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_COMMENT_END = re.compile(r"--!?>")
_TAG_END = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"\b(?:class|id|role|itemprop|aria-label|data-role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_PIECE = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "words", "parent", "children", "text", "links", "depth", "controls", "spot")

    def __init__(self, tag: str, words: frozenset, parent: Node | None):
        self.tag, self.words, self.parent = tag, words, parent
        self.children: list[Node] = []
        self.text = ""
        self.links = self.controls = self.spot = 0
        self.depth = parent.depth + 1 if parent else 0


def tags(page: str, skip):
    """(start, end, closing, name, attributes) of each tag, name None for comments and declarations; skip(end) is where to go on.

    One pass: a mark that never ends is text, and so are all later ones of its kind. A ">" between quotes ends no tag, up to the
    first tag whose quotes stay open to the end of the page; from there on quotes are not minded.
    """
    at, end = 0, len(page)
    last = page.rfind(">")
    quotes = True
    while (start := page.find("<" if at <= last else "<!--", at)) >= 0:
        mark = page[start + 1 : start + 2]
        if start > last and not page.startswith("!--", start + 1):
            at = start + 1
            continue
        if page.startswith("!--", start + 1):
            m = _COMMENT_END.search(page, start + 4)
            at = m.end() if m else end
            yield start, at, False, None, ""
        elif mark and mark in "!?":
            at = page.find(">", start) + 1
            yield start, at, False, None, ""
        elif m := _NAME.match(page, start + 1 + (mark == "/")):
            closing, stop = mark == "/", m.end()
            if closing or not quotes:
                stop = page.find(">", stop)
            else:
                while (found := _TAG_END.search(page, stop)) and found[0] != ">":
                    stop = page.find(found[0], found.end()) + 1
                    if not stop:
                        break
                quotes = bool(found) and stop > 0
                stop = found.start() if quotes else page.find(">", m.end())
            if stop < 0:
                at = start + 1
                continue
            at = stop + 1
            yield start, at, closing, m[0].lower(), page[m.end() : stop]
        else:
            at = start + 1
            continue
        at = skip(at)


class _Open:
    """The open elements of a page. Inline ones stay with the block they stand in; places tells where each block name is open."""

    def __init__(self, root: Node):
        self.stack: list[tuple[str, Node]] = [(root.tag, root)]
        self.places: dict[str, list[int]] = {root.tag: [0]}
        self.blocks = [0]
        self.inline: list[dict[str, int]] = [{}]
        self.links = 0

    def add(self, name: str, node: Node | None = None) -> None:
        if node is None:
            self.links += name == "a"
            self.inline[-1][name] = self.inline[-1].get(name, 0) + 1
            self.stack.append((name, self.stack[-1][1]))
        else:
            self.places.setdefault(name, []).append(len(self.stack))
            self.blocks.append(len(self.stack))
            self.inline.append({})
            self.stack.append((name, node))

    def nearest(self, names) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def innermost(self, name: str) -> int:
        """Where the element lies that an end tag closes, or -1: an inline one within its block only."""
        if name not in INLINE:
            return self.nearest((name,)) or -1
        if not self.inline[-1].get(name):
            return -1
        k = len(self.stack) - 1
        while self.stack[k][0] != name:
            k -= 1
        return k

    def pop_to(self, k: int) -> None:
        while len(self.stack) > k:
            name, _ = self.stack.pop()
            if self.blocks[-1] == len(self.stack):
                self.blocks.pop(), self.inline.pop(), self.places[name].pop()
            else:
                self.inline[-1][name] -= 1
            self.links -= name == "a"


def parse(page: str) -> Node:
    """The tree of block elements. Unclosed elements end where HTML would end them; stray end tags are passed over. The time is
    linear in the page, however broken it is."""
    root = Node("html", frozenset(), None)
    is_open = _Open(root)
    run: list[str] = []
    links = at = raw_end = 0
    end = len(page)
    lower = None

    def close_run():
        nonlocal run, links
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            if text:
                block = is_open.stack[-1][1]
                leaf = Node("#text", frozenset(), block)
                leaf.text, leaf.links = text, min(links, len(text))
                block.children.append(leaf)
            run, links = [], 0

    def pop_to(k: int):
        if k <= is_open.blocks[-1]:
            close_run()
        is_open.pop_to(k)

    for start, stop, closing, name, attributes in tags(page, lambda x: max(x, raw_end)):
        if start > at:
            run.append(page[at:start])
            links += (start - at) * (is_open.links > 0)
        at = stop
        if name is None:
            continue
        if closing:
            k = is_open.innermost(name)
            if k > 0:
                pop_to(k)
            elif name == "p":
                close_run()
            if name in ("br", "td", "th"):
                run.append(" ")
            continue
        if name in RAW:
            if name == "select":
                is_open.stack[-1][1].controls += 1
            lower = page.lower() if lower is None else lower
            found = lower.find(f"</{name}", at) if len(lower) == end else page.find(f"</{name}", at)
            at = raw_end = end if found < 0 else (page.find(">", found) + 1 or end)
            continue
        if name == "br":
            run.append(" ")
            continue
        if name in CONTROLS:
            is_open.stack[-1][1].controls += 1
        if name in VOID:
            if name == "hr":
                close_run()
            continue
        if name in INLINE:
            if not attributes.rstrip().endswith("/"):
                is_open.add(name)
            continue
        if name in ("html", "body") and is_open.places.get(name):
            continue
        close_run()
        if name not in IN_PARAGRAPH and is_open.stack[is_open.blocks[-1]][0] == "p":
            pop_to(is_open.blocks[-1])
        if name in PEERS and (k := is_open.nearest(PEERS[name])) > is_open.nearest(HOLDERS[name]):
            pop_to(k)
        found = frozenset(_PIECE.findall(_CAMEL.sub(" ", " ".join(_ATTRIBUTE.findall(attributes))).lower())) if attributes and "=" in attributes else frozenset()
        node = Node(name, found & _WORDS, is_open.stack[-1][1])
        node.parent.children.append(node)
        is_open.add(name, node)
    if at < end:
        run.append(page[at:])
    close_run()
    return root


FEATURES = (
    [f"tag_{t}" for t in TAGS]
    + [f"word_{w}" for w in GOOD_WORDS + BAD_WORDS]
    + "bad_above good_above nav_above article_above form_above list_above depth depth_below_good n_text log_text n_links link_share n_words stops commas n_leaves n_blocks tags_per_100 n_controls n_children n_list n_par share_of_parent share_of_page spot spot_end n_siblings sibling_mean same_tag n_good n_bad heading_before text_before mean_leaf".split()
)
_BAD_TAGS = frozenset("nav header footer aside form button fieldset".split())


def node_features(root: Node) -> tuple[list[Node], np.ndarray]:
    """Nodes in document order (a parent before its children) and their feature rows."""
    nodes, todo = [], [root]
    while todo:
        n = todo.pop()
        n.spot = len(nodes)
        nodes.append(n)
        todo.extend(reversed(n.children))
    k = len(nodes)
    own = np.zeros((k, 11))  # text, links, words, stops, commas, leaves, blocks, controls, list items, paragraphs, headings
    for i, n in enumerate(nodes):
        t = n.text
        if n.tag == "#text":
            own[i, :6] = len(t), n.links, t.count(" ") + 1, t.count(". ") + t.count("! ") + t.count("? ") + (t[-1] in ".!?"), t.count(","), 1
        else:
            own[i, 6:] = 1, n.controls, n.tag == "li", n.tag == "p", n.tag[0] == "h" and n.tag[1:].isdigit()
    total = own.copy()
    for n in reversed(nodes):
        if n.parent is not None:
            total[n.parent.spot] += total[n.spot]
    at = {name: j for j, name in enumerate(FEATURES)}
    x = np.zeros((k, len(FEATURES)))
    above = np.zeros((k, 7))  # bad words, good words, nav-like tags, article tags, forms, lists, depth below the first good one
    text = total[:, 0]
    first_words = len(TAGS)
    word_at = {w: first_words + j for j, w in enumerate(GOOD_WORDS + BAD_WORDS)}
    good = frozenset(GOOD_WORDS)
    page = max(1.0, text[0])
    for i, n in enumerate(nodes):
        row = x[i]
        if (j := at.get(f"tag_{n.tag}")) is not None:
            row[j] = 1
        for w in n.words:
            row[word_at[w]] = 1
        if n.parent is not None:
            p = n.parent
            a = above[p.spot].copy()
            a[0] += len(p.words - good)
            a[1] += len(p.words & good)
            a[2] += p.tag in _BAD_TAGS
            a[3] += p.tag in ("article", "main")
            a[4] += p.tag == "form"
            a[5] += p.tag in ("ul", "ol", "dl")
            a[6] += a[1] + a[3] > 0
            above[i] = a
        seen = 0.0
        heading = False
        m = len(n.children)
        mean = text[n.spot] / m if m else 0
        for s, c in enumerate(n.children):
            x[c.spot, at["share_of_parent"]] = text[c.spot] / max(1.0, text[i])
            x[c.spot, at["spot"]] = s
            x[c.spot, at["spot_end"]] = m - 1 - s
            x[c.spot, at["n_siblings"]] = m
            x[c.spot, at["sibling_mean"]] = mean
            x[c.spot, at["heading_before"]] = heading
            x[c.spot, at["text_before"]] = seen / page
            seen += text[c.spot]
            heading = heading or total[c.spot, 10] > 0
        alike = Counter(c.tag for c in n.children)
        for c in n.children:
            x[c.spot, at["same_tag"]] = alike[c.tag]
    for j, name in enumerate(("bad_above", "good_above", "nav_above", "article_above", "form_above", "list_above", "depth_below_good")):
        x[:, at[name]] = above[:, j]
    x[:, at["depth"]] = [n.depth for n in nodes]
    x[:, at["n_text"]], x[:, at["log_text"]], x[:, at["n_links"]] = text, np.log1p(text), total[:, 1]
    x[:, at["link_share"]] = total[:, 1] / np.maximum(1, text)
    x[:, at["n_words"]] = total[:, 2]
    x[:, at["stops"]], x[:, at["commas"]] = total[:, 3] / np.maximum(1, total[:, 2]), total[:, 4] / np.maximum(1, total[:, 2])
    x[:, at["n_leaves"]], x[:, at["n_blocks"]] = total[:, 5], total[:, 6]
    x[:, at["tags_per_100"]] = 100 * total[:, 6] / np.maximum(1, text)
    x[:, at["n_controls"]], x[:, at["n_list"]], x[:, at["n_par"]] = total[:, 7], total[:, 8], total[:, 9]
    x[:, at["n_children"]] = [len(n.children) for n in nodes]
    x[:, at["share_of_page"]] = text / page
    x[:, at["n_good"]] = [len(n.words & good) for n in nodes]
    x[:, at["n_bad"]] = [len(n.words - good) for n in nodes]
    x[:, at["mean_leaf"]] = text / np.maximum(1, total[:, 5])
    return nodes, x


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """The likeliest labels such that a node is main only if its parent is."""
    yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    yes, no = yes.copy(), no.copy()
    for n in reversed(nodes):  # children come after their parents
        if n.parent is not None:
            p = n.parent.spot
            yes[p] += max(yes[n.spot], no[n.spot])
            no[p] += no[n.spot]
    keep = np.zeros(len(nodes), bool)
    for i, n in enumerate(nodes):
        keep[i] = (n.parent is None or keep[n.parent.spot]) and yes[i] > no[i]
    return keep


def generated(rng: random.Random) -> str:
    """A page whose main text lies in leaves that start with the mark \\u2021; attributes, order and wording vary."""
    word = lambda: "".join(rng.choice(["an", "er", "th", "on", "le", "qu", "ei", "os", "ta", "in", "re"]) for _ in range(rng.randint(1, 4)))
    phrase = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    line = lambda: phrase(2, 18).capitalize() + rng.choice([".", ".", ".", "?", "!", ""])
    prose = lambda a, b: " ".join(line() for _ in range(rng.randint(a, b)))
    some = lambda tag, words: f"<{tag}{rng.choice([' class=', ' id=', ' class='])}\"{rng.choice(words)}{rng.choice(['', '', '-box', ' wrap', '_1'])}\">"
    bare = lambda tag, words: f"<{tag}>" if rng.random() < 0.5 else some(tag, words)
    M = "‡"

    def items(n, link=True):
        return "".join(f'<li><a href="/{word()}">{phrase(1, 4)}</a></li>' if link else f"<li>{phrase(1, 8)}</li>" for _ in range(n))

    def menu():
        body = f"<ul>{items(rng.randint(3, 9))}</ul>"
        return rng.choice([lambda: f"{bare('nav', ['menu', 'nav', 'navigation'])}{body}</nav>", lambda: f"{some('div', ['menu', 'nav', 'navbar nav', 'top-menu', 'breadcrumb', 'pagination'])}{body}</div>"])()

    def header():
        tag = rng.choice(["header", "header", "div"])
        own = bare("header", ["site-header", "masthead"]) if tag == "header" else some("div", ["header", "masthead", "banner"])
        return f"{own}{rng.choice(['', '<h1>' + phrase(1, 3) + '</h1>', '<p>' + phrase(2, 6) + '</p>', phrase(1, 4)])}{menu() if rng.random() < 0.4 else ''}</{tag}>"

    def footer():
        tag = rng.choice(["footer", "footer", "div"])
        own = bare("footer", ["site-footer", "footer"]) if tag == "footer" else some("div", ["footer", "copyright", "legal"])
        return f"{own}{rng.choice(['&copy; ' + word() + ' &middot; ' + line(), '<p>' + prose(1, 3) + '</p>', '<ul>' + items(4) + '</ul>'])}</{tag}>"

    def advert():
        tag = rng.choice(["div", "div", "section", "aside"])
        return f"{some(tag, ['ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'ad-slot'])}{rng.choice([line(), '<p>' + prose(1, 2) + '</p>', prose(1, 3)])}</{tag}>"

    def notice():
        return f"{some('div', ['cookie', 'cookies', 'notice', 'consent', 'gdpr', 'alert', 'popup'])}{rng.choice(['', '<p>'])}{prose(1, 3)}{rng.choice(['', '<button>' + word() + '</button>'])}</div>"

    def side():
        tag = rng.choice(["aside", "aside", "div"])
        own = bare("aside", ["sidebar", "related", "widget"]) if tag == "aside" else some("div", ["sidebar", "related", "widget", "recommended"])
        return f"{own}<h3>{phrase(1, 3)}</h3>{rng.choice(['<ul>' + items(5) + '</ul>', '<p>' + prose(1, 4) + '</p>', '<p>' + prose(1, 2) + '</p><p>' + line() + '</p>'])}</{tag}>"

    def form():
        return f"{bare('form', ['newsletter', 'search', 'login', 'subscribe'])}<label>{phrase(1, 4)}</label><input name=q><p>{line()}</p><button>{word()}</button></form>"

    def share():
        return f"{some('div', ['share', 'social', 'tags', 'toolbar'])}{' '.join('<a href=#>' + word() + '</a>' for _ in range(4))}</div>"

    def comments():
        tag = rng.choice(["section", "div", "ol", "ul"])
        each = lambda: rng.choice([f'<div class="comment"><b>{word()}</b><p>{prose(1, 4)}</p></div>', f"<div class=\"comment-body\">{prose(1, 3)}</div>", f"<p>{prose(1, 3)}</p>", f"<article class=comment><p>{prose(1, 3)}</p></article>"])
        inner = "".join(f"<li>{each()}</li>" if tag in ("ol", "ul") else each() for _ in range(rng.randint(1, 6)))
        return f"{some(tag, ['comments', 'comment-list', 'replies', 'discussion', 'respond', 'disqus'])}{rng.choice(['', '<h3>' + phrase(1, 2) + '</h3>'] if tag in ('section', 'div') else [''])}{inner}</{tag}>"

    def block():
        kind = rng.random()
        if kind < 0.72:
            text = f"{M}{rng.choice(['', '', '<b>', '<em>'])}{prose(1, 6)}"
            if rng.random() < 0.3:
                text += f' <a href="/{word()}">{phrase(1, 4)}</a> {line()}'
            return f"<p>{text}{rng.choice(['</p>', '</p>', '<br>', ''])}"
        if kind < 0.8:
            return f"<h{(h := rng.choice('23'))}>{M}{phrase(1, 7)}</h{h}>"
        if kind < 0.87:
            return f"<ul>{''.join(f'<li>{M}{line()}</li>' for _ in range(rng.randint(2, 5)))}</ul>"
        if kind < 0.92:
            return f"<blockquote>{rng.choice(['', '<p>'])}{M}{prose(1, 3)}</blockquote>"
        if kind < 0.95:
            return f"<pre>{M}{phrase(3, 12)}</pre>"
        if kind < 0.98:
            return f"<table>{''.join(f'<tr><td>{M}{phrase(1, 3)}</td><td>{M}{phrase(1, 3)}</td></tr>' for _ in range(3))}</table>"
        return f"<div>{M}{prose(1, 4)}</div>"

    inside = [advert, side, share, form, notice]
    main = f"<h1>{M}{phrase(2, 10)}</h1>" if rng.random() < 0.85 else ""
    if rng.random() < 0.2:
        main += f"{some('div', ['meta', 'byline'])}{phrase(1, 4)}</div>"
    for _ in range(rng.choice([1, 2, 3, 5, 8, 14])):
        main += block()
        if rng.random() < 0.08:
            main += rng.choice(inside)()
    if rng.random() < 0.12:
        main += comments()
    opening, closing = rng.choice(
        [("<article>", "</article>")] * 4
        + [("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div id="content">', "</div>"), ('<div class="post-content entry">', "</div>"), ('<section class="article-body">', "</section>"), ('<div class="story"><div class="text">', "</div></div>"), ('<div id="main"><div class="post">', "</div></div>"), ("<div><div>", "</div></div>"), ('<div role="main">', "</div>"), ('<td class="content">', "</td>")]
    )
    if "td" in opening:
        opening, closing = "<table><tr><td>" + menu() + "</td>" + opening, closing + "</tr></table>"
    body = opening + main + closing if rng.random() < 0.96 else ""
    before = [f() for f in (header, menu, advert, notice, form) if rng.random() < 0.45]
    after = [f() for f in (comments, side, advert, share, form, footer, notice) if rng.random() < 0.4]
    rng.shuffle(before), rng.shuffle(after)
    if rng.random() < 0.5:
        after.append(footer())
    middle = "".join(before) + body + "".join(after)
    if rng.random() < 0.25:
        middle = f"<div{rng.choice(['', ' class=page', ' id=wrapper'])}>{middle}</div>"
    return f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{phrase(2, 6)}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head><body>{middle}</body></html>"


@lru_cache(maxsize=1)
def trained(pages: int = TRAIN_PAGES, seed: int = SEED) -> BoostedTrees:
    rng = random.Random(seed)
    rows, labels = [], []
    for _ in range(pages):
        nodes, own = node_features(parse(generated(rng).replace("‡", "‡ ")))
        main = np.array([n.text.startswith("‡") for n in nodes])
        for n in reversed(nodes):
            if n.parent is not None:
                main[n.parent.spot] |= main[n.spot]
        rows.append(own), labels.append(main)
    return BoostedTrees().fit(np.concatenate(rows), np.concatenate(labels).astype(float))


def main_texts(pages: list[str], model: BoostedTrees) -> list[str]:
    """The main text of each page: its blocks, white space made single, joined by line ends."""
    trees = [node_features(parse(p)) for p in pages]
    if not trees:
        return []
    odds = model.log_odds(np.concatenate([x for _, x in trees]))
    out, at = [], 0
    for nodes, x in trees:
        keep = decode(nodes, odds[at : at + len(x)])
        at += len(x)
        out.append("\n".join(n.text for n, k in zip(nodes, keep) if k and n.tag == "#text"))
    return out


def extracted(pages: DataFrame, model: BoostedTrees | None = None) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of pages.

    A null or empty html, or one without main text, gives an empty text. Broken markup is read as far as it goes, very long pages
    whole and in linear time. Null ids and urls are kept, repeated rows too; extra columns go; an empty table gives an empty result.
    """
    import pyarrow as pa

    model = model or trained()
    names = ["page_id", "url", "text", "n_chars"]

    def run(batches):
        for b in batches:
            texts = main_texts(b.column(2).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names)

    bounded_batches(pages.sparkSession)
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
