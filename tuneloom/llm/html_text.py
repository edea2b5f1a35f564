"""Main text of web pages by composite text density.

Every node of the page's tree gets the characters and tags below it, with and without links. Its density is

    chars / tags * log(chars / link_chars * tags / link_tags) / log(chars / other_chars * link_chars + share * chars + e)

where share is the part of the body's text that stands in links: many characters per tag count for a node, links against
it. A node's sum adds the densities of its children (own text counts as a child). The node with the largest sum is the core; a
core that is a part of running text is taken with the container around it, and it grows to the outermost element around it
that is `GROWTH` as dense, an article or main `MAIN_GROWTH`. The least density on the path from the core to the body, and
no less than `LEAST` of the core's, is the threshold. The text is the core and every node outside it that reaches the
threshold, without the containers that stay below it and are mostly links; headings right before the core, or before what
holds it, belong to it.

Names weigh in this and don't decide: the text of menus, forms, headers, footers, sidebars, and of elements whose class,
id or role says menu, advert, notice, comment and the like, counts as link text, so their density is 0. It does not where
such an element holds an article or main, or blocks with most of the page's text outside links (an article named a comment
inside another article counts all the same, and much text keeps no comments beside an article with text of its own).
Names that tell of a state (has-sidebar, no-comments, menu-open) say nothing. Scripts, styles, controls and hidden
elements are no text at all.

White space inside a block becomes one space, blocks are joined by line breaks in page order. Cases: null or empty html
and pages without text give an empty text. Broken markup is closed as browsers do for paragraphs, list items and
table cells; an element left open ends with the element around it, a control also before the next block; a closing slash
counts on void elements only; an unfinished tag at the end is dropped. Rows are answered one by one, so repeated rows, null ids and ties
need no rule. Other columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneloom.llm.text import slices

# Elements of the HTML standard by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
NEVER = frozenset(
    "head script style noscript template iframe object svg math canvas audio video select button textarea title xmp noembed noframes input "
    "option datalist".split())
CONTROLS = frozenset("select button option datalist".split())
ASIDE_ELEMENTS = frozenset("form nav footer aside menu dialog".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "html legend li main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul".split())
ENDS_PARAGRAPH = BLOCKS - frozenset("body html caption tbody td tfoot th thead tr legend".split())
#: An opening tag closes an open element of these names, down to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
#: Words of class and id names of containers that are not main text.
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer disqus footer "
    "gdpr login masthead menu modal nav navbar navigation newsletter notice notices pagination paywall popup promo promotion promoted recommended "
    "related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget".split())
#: Of these, words of readers' comments.
COMMENT_WORDS = frozenset("comment comments disqus reply replies respond".split())
#: A word after one of the first, or before one of the second as the name's last, tells of a state: has-sidebar, menu-open.
STATE_BEFORE = frozenset("has have is no not with without".split())
STATE_AFTER = frozenset("open opened closed enabled disabled collapsed off".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert form".split())
MAIN_ELEMENTS = frozenset({"article", "main"})
#: A core that is a part of the running text grows to the container around it.
CONTAINERS = MAIN_ELEMENTS | {"body", "div", "section", "td"}
#: Containers that are no part of a running text if they are mostly links.
LISTS = CONTAINERS | frozenset("ul ol dl table".split())
HEADINGS = frozenset({"h1", "h2"})
#: How dense an element has to be, as a share of the core's density, for the core to grow to it: any container, and an article or main.
GROWTH, MAIN_GROWTH = 0.7, 0.3
#: The threshold is this share of the core's density at least.
LEAST = 0.4

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<(?=[a-zA-Z/!])[^>]*+\Z""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HIDDEN = re.compile(r"(?<![\w-])(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)


@dataclass
class Tree:
    """Nodes in page order: name, parent, and the texts with their node."""

    names: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    texts: list[tuple[int, str]] = field(default_factory=list)
    asides: dict[int, set[str]] = field(default_factory=dict)  # the aside words and names of nodes that have some


def _attributes(text: str) -> dict[str, str]:
    """Values by lower-case name; the first of a name counts."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), "".join(values))
    return found


def _hidden(attributes: dict[str, str]) -> bool:
    if "hidden" in attributes and attributes["hidden"].strip().lower() != "until-found":
        return True
    return bool(_HIDDEN.search(attributes.get("style", "")))


def _aside_words(attributes: dict[str, str]) -> set[str]:
    """The words of class, id and role by which an element is not main text."""
    words: set[str] = set()
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        parts = [x for x in re.split(r"[^a-z]+", name) if x]
        if len(parts) > 1 and parts[-1] in STATE_AFTER:
            del parts[-2:]
        words.update(x for k, x in enumerate(parts) if not (k and parts[k - 1] in STATE_BEFORE))
    role = attributes.get("role", "").strip().lower()
    return words & ASIDE_WORDS | ({role} & ASIDE_ROLES)


def parse(page: str) -> Tree:
    """The tree of the page's text; elements that never hold any have gone with everything inside."""
    tree = Tree(["body"], [-1], [])
    stack = [0]
    skipped: list[str] = []  # open elements of the part left out
    at, end, names, n = 0, len(page), tree.names, 0
    while at < end:
        found = _MARKUP.search(page, at)
        stop = found.start() if found else end
        if stop > at and not skipped:
            tree.texts.append((stack[-1], page[at:stop]))
        if not found:
            break
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        attributes = found[3] or found[6] or ""
        if found[1] or found[4]:
            if name in skipped:
                while skipped.pop() != name:
                    pass
            elif name in ("body", "html"):
                skipped.clear()
            elif any(names[k] == name for k in stack[1:]):
                # the end of what is around it ends a part left open, too
                skipped.clear()
                while names[stack.pop()] != name:
                    pass
            continue
        if skipped and skipped[0] in CONTROLS and (name in BLOCKS or name == skipped[0]):
            skipped.clear()
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = _after(page, close.start()) if close else end
            continue
        if skipped:
            if name not in VOID:
                skipped.append(name)
            continue
        if name in ENDS_PARAGRAPH:
            _close(stack, names, {"p"}, {"div", "article", "section", "td", "th", "li", "main", "body", "blockquote"})
        if name in CLOSES:
            _close(stack, names, *CLOSES[name])
        if name in ("html", "body"):
            continue
        values = _attributes(attributes) if attributes else {}
        if name in NEVER or (name not in MAIN_ELEMENTS and _hidden(values)):
            if name not in VOID:
                skipped.append(name)
            continue
        words = _aside_words(values) if values.keys() & {"class", "id", "role"} else set()
        if name in ASIDE_ELEMENTS or (name == "header" and not any(names[k] in MAIN_ELEMENTS for k in stack)):
            words = words | {name}
        names.append(name)
        tree.parents.append(stack[-1])
        n += 1
        if words:
            tree.asides[n] = words
        if name == "br":
            tree.texts.append((n, " "))
        else:
            tree.texts.append((n, ""))  # marks the begin of a block, also of an empty one
            if name not in VOID:
                stack.append(n)
    return tree


def _after(page: str, at: int) -> int:
    stop = page.find(">", at)
    return len(page) if stop < 0 else stop + 1


def _close(stack: list[int], names: list[str], closing: set[str], fence: set[str]) -> None:
    for depth in range(len(stack) - 1, 0, -1):
        name = names[stack[depth]]
        if name in closing:
            del stack[depth:]
            return
        if name in fence:
            return


def asides(tree: Tree) -> list[bool]:
    """The nodes whose text counts as link text: those with aside words that don't hold the main text, and all in them."""
    n, names, parents = len(tree.names), tree.names, tree.parents
    if not tree.asides:
        return [False] * n
    in_link, in_article, plain, blocks, holds = [False] * n, [False] * n, [0] * n, [False] * n, [False] * n
    comments = [bool(tree.asides.get(k, set()) & COMMENT_WORDS) for k in range(n)]
    for k in range(1, n):
        in_link[k] = names[k] == "a" or in_link[parents[k]]
        in_article[k] = in_article[parents[k]] or (names[parents[k]] == "article" and not comments[parents[k]])
    for k, text in tree.texts:
        if not in_link[k]:
            plain[k] += len(" ".join(text.split()))
    for k in range(n - 1, 0, -1):
        plain[parents[k]] += plain[k]
        blocks[parents[k]] |= blocks[k] or names[k] in BLOCKS
        holds[parents[k]] |= holds[k] or (names[k] in MAIN_ELEMENTS and not comments[k])
    articles = [k for k in range(1, n) if names[k] == "article" and not comments[k]]
    aside = [False] * n
    for k in range(1, n):
        aside[k] = aside[parents[k]]
        if aside[k] or k not in tree.asides or holds[k]:
            continue
        if names[k] in MAIN_ELEMENTS and not (comments[k] and in_article[k]):
            continue
        aside[k] = not blocks[k] or 2 * plain[k] <= plain[0]
        if comments[k] and not aside[k]:
            above, up = set(), parents[k]
            while up > 0:
                above.add(up)
                up = parents[up]
            aside[k] = any(plain[a] > (plain[k] if a in above else 0) for a in articles)
    return aside


@dataclass
class Measured:
    """Per node: characters, link characters, density, and the sum over its children."""

    chars: list[int]
    link_chars: list[int]
    density: list[float]
    total: list[float]


def densities(tree: Tree, aside: list[bool]) -> Measured:
    n = len(tree.names)
    chars, tags, link_chars, link_tags, own = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for node, text in tree.texts:
        size = len(" ".join(text.split()))
        chars[node] += size
        own[node] += size
    for node in range(n - 1, 0, -1):
        if tree.names[node] == "a" or aside[node]:
            link_chars[node], link_tags[node] = chars[node], 1 + link_tags[node]
        parent = tree.parents[node]
        chars[parent] += chars[node]
        tags[parent] += 1 + tags[node]
        link_chars[parent] += link_chars[node]
        link_tags[parent] += link_tags[node]
    share = link_chars[0] / chars[0] if chars[0] else 0.0
    density, total = [0.0] * n, [0.0] * n
    for node in range(n - 1, -1, -1):
        c, t, lc, lt = chars[node], max(tags[node], 1), link_chars[node], link_tags[node]
        if c > lc:
            base = math.log(c / (c - lc) * lc + share * c + math.e)
            density[node] = c / t * max(0.0, math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0))) / base
            total[node] += own[node]
        if node:
            total[tree.parents[node]] += density[node]
    return Measured(chars, link_chars, density, total)


def core_of(tree: Tree, m: Measured) -> tuple[int, int]:
    """The container of the node of the largest sum, the first on ties, and what it grows to."""
    first = max(range(len(tree.names)), key=lambda k: (m.total[k], -k))
    while tree.names[first] not in CONTAINERS:
        first = tree.parents[first]
    core = node = first
    while node:
        node = tree.parents[node]
        if m.density[node] >= (MAIN_GROWTH if tree.names[node] in MAIN_ELEMENTS else GROWTH) * m.density[first]:
            core = node
    return first, core


def chosen(tree: Tree, aside: list[bool]) -> list[bool]:
    """Which nodes belong to the main text."""
    n, names, parents = len(tree.names), tree.names, tree.parents
    m = densities(tree, aside)
    if not any(m.total):
        return [False] * n
    first, core = core_of(tree, m)
    path, node = [], first
    while node >= 0:
        path.append(node)
        node = parents[node]
    threshold, on_path = max(min(m.density[k] for k in path), LEAST * m.density[first]), set(path)
    # headings in a row right before a node of the path
    heads: dict[int, list[int]] = {}
    for k in range(1, first):
        if parents[k] in on_path and k not in on_path:
            heads[parents[k]] = [*heads.get(parents[k], []), k] if names[k] in HEADINGS else []
    title = {k for run in heads.values() for k in run if not aside[k] and 2 * m.link_chars[k] < m.chars[k]}
    found, gone = [False] * n, [False] * n
    for k in range(n):
        up = parents[k]
        poor = aside[k] or (names[k] in LISTS and m.density[k] < threshold and 2 * m.link_chars[k] > m.chars[k])
        gone[k] = (k > 0 and gone[up]) or (poor and k not in on_path)
        found[k] = k == core or k in title or (k > 0 and found[up]) or (k not in on_path and m.density[k] >= threshold > 0)
    return [f and not g for f, g in zip(found, gone, strict=True)]


def main_text(page: str | None) -> str:
    tree = parse(page or "")
    kept = chosen(tree, asides(tree))
    block = [0] * len(tree.names)
    for k in range(1, len(block)):
        block[k] = k if tree.names[k] in BLOCKS else block[tree.parents[k]]
    blocks: list[str] = []
    part: list[str] = []
    seen = -1
    for node, text in tree.texts:
        if not kept[node]:
            continue
        if block[node] != seen:
            blocks.append("".join(part))
            part, seen = [], block[node]
        part.append(text)
    blocks.append("".join(part))
    cleaned = (" ".join(entities.unescape(b).split()) for b in blocks)
    return "\n".join(b for b in cleaned if b)


_TEXT_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=_TEXT_ARROW)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
