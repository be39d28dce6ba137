"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

Pages of a host are token streams of tags and texts. Their wrapper starts as one page's stream and
is aligned with one page after the other: tags that both have are matched, what only one has
becomes optional, neighbours of one form become a repeated group, and texts that differ become
slots. All different pages of a host are aligned: groups of them into partial wrappers, and groups
of those in turn. The finished wrapper shows where the host's articles stand, per template if there
are several, and which texts belong to it. A page that doesn't fit is read with a wrapper of its own.
"""

from __future__ import annotations

import html
import json
import pickle
import re
import sys
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.session import cut_lineage

#: Pages, or partial wrappers, that a task aligns at once.
GROUP_PAGES = 64
#: Wrappers of up to this many bytes in all are broadcast; more are joined by host.
BROADCAST_BYTES = 16 << 20
#: The share of a container's text that a child must hold to be looked into instead.
SHARE = 0.6
#: With less of a page's text than this outside marked elements, the one that holds most is kept.
LEFT_OVER = 0.2
#: Pages that must have a line of an article, and the share of the article's text that all such lines may
#: have, for the line to belong to the template.
TEMPLATE_PAGES = 8
TEMPLATE_SHARE = 0.2

#: What attributes of up to this many characters say of their element is remembered per worker, for so many.
KNOWN_LENGTH = 256
KNOWN_ELEMENTS = 1 << 12

#: Element names, roles and class words (fixed values, by their meaning in HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr "
    "ul caption option".split()
)
CONTAINERS = frozenset("html body div section main article center table tbody tr td blockquote".split())
CLOSES_P = BLOCKS - {"html", "body", "caption", "option", "td", "th", "tr", "tbody", "thead", "tfoot"}
CLOSED_BY_SAME = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
DROPPED = frozenset(
    "head title nav footer aside form script style noscript template svg iframe button select textarea input dialog menu "
    "object canvas audio video xmp noembed noframes".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu".split())
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner sidebar nav navbar navigation menu "
    "breadcrumb breadcrumbs footer masthead comment comments reply replies respond disqus cookie cookies consent gdpr "
    "notice alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended "
    "widget toolbar pagination pager login search disclaimer".split()
)

#: A comment's start, that of a declaration or instruction, or a whole tag: its slash, name and attributes.
MARKUP = re.compile(
    r"""<(?:(!--)|[!?]|(/?)([A-Za-z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)(?:>|["'][^>]*+>?|\Z))"""
)
RAW_END = {name: re.compile(f"</{name}(?![\\w-])", re.IGNORECASE) for name in RAW}
ATTRIBUTE = re.compile(r"""([A-Za-z][\w:.-]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Attributes without any of these ("hidden" has "id" in it) say nothing of their element.
TELLING = re.compile("class|id|role", re.IGNORECASE)


@dataclass(slots=True)
class Element:
    """An element; ``label`` tells elements apart in the alignment."""

    name: str
    label: str
    dropped: bool = False
    children: list = field(default_factory=list)  # elements and texts, in page order
    marked: bool = False  # dropped for a word of its class or id alone, or as a form


def described(name: str, attributes: str, in_article: bool) -> tuple[str, bool, bool]:
    """An element's label, and whether its name, role, class or id says that it isn't the article's text."""
    label, dropped = name, (name in DROPPED and name != "form") or (name == "header" and not in_article)
    marked = name == "form"
    if attributes:
        found = {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(attributes)}
        role, marks = found.get("role", "").lower(), f"{found.get('class', '')} {found.get('id', '')}"
        words = {w.lower() for w in WORDS.findall(marks)}
        if name not in ("html", "body", "main"):
            hidden = "hidden" in found or found.get("aria-hidden") == "true"
            dropped = dropped or hidden or role in DROPPED_ROLES
            marked = marked or bool(words & DROPPED_WORDS)
        classes = [c for c in found.get("class", "").split() if not any(x.isdigit() for x in c)]
        label = ".".join([name, *sorted(classes)]) + (f"@{role}" if role else "")
    return label, dropped or marked, marked and not dropped


known = lru_cache(KNOWN_ELEMENTS)(described)


def element(name: str, attributes: str, in_article: bool) -> Element:
    if attributes and not TELLING.search(attributes):
        attributes = ""
    look = known if len(attributes) <= KNOWN_LENGTH else described
    label, dropped, marked = look(name, attributes, in_article)
    return Element(name, label, dropped, [], marked)


def settle(root: Element) -> Element:
    """Take back marks that a page contradicts.

    A marked element is kept if it is or holds the article (or main element) with half of the page's
    text; and, while hardly any text is left outside marked elements, the largest marked article
    is, or else the outermost marked element that holds most of the text.
    """
    order: list[Element] = []
    above: list[int] = []  # where each one's parent stands
    todo = [(root, -1)]
    while todo:
        node, up = todo.pop()
        place = len(order)
        order.append(node)
        above.append(up)
        for child in node.children:
            if child.__class__ is Element and (child.marked or not child.dropped):
                todo.append((child, place))
    if not any(node.marked for node in order):
        return root
    # Characters of each element's own texts, and of all its texts outside links.
    own = [0 if n.name == "a" else sum([len(" ".join(c.split())) for c in n.children if c.__class__ is str]) for n in order]
    whole = own[:]
    for place in range(len(order) - 1, 0, -1):
        if order[above[place]].name != "a":
            whole[above[place]] += whole[place]

    def outside_marks() -> int:
        """Of the page's characters, those outside marked elements."""
        plain = own[:]
        for place in range(len(order) - 1, 0, -1):
            if not order[place].marked and order[above[place]].name != "a":
                plain[above[place]] += plain[place]
        return plain[0]

    def keep(place: int) -> None:
        while place >= 0:
            node = order[place]
            if node.marked:
                node.dropped = node.marked = False
            place = above[place]

    total = whole[0]
    articles = [i for i, n in enumerate(order) if n.name in ("article", "main")]
    largest = max(articles, key=whole.__getitem__, default=None)
    if largest is not None and 2 * whole[largest] >= total:
        keep(largest)
    while total and outside_marks() < LEFT_OVER * total:
        marked = [i for i in articles if order[i].marked and whole[i] >= LEFT_OVER * total]
        held = max(marked, key=whole.__getitem__, default=None)
        if held is None:
            held = next((i for i, n in enumerate(order) if n.marked and whole[i] >= SHARE * total), None)
        if held is None:
            break
        keep(held)
    return root


def parse(page: str) -> Element:
    """The page's tokens, nested; end tags that HTML allows to leave out are added."""
    root = Element("#root", "#root")
    stack: list[tuple[str, Element]] = [("#root", root)]
    opened: defaultdict[str, int] = defaultdict(int)  # open elements by name, to look only for those that exist
    at, end = 0, len(page)
    search = MARKUP.search

    def close(depth: int) -> None:
        for name, _ in stack[depth:]:
            opened[name] -= 1
        del stack[depth:]

    def close_inside(names: set[str], limits: set[str]) -> None:
        if not any(opened[name] for name in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                close(i)
            elif stack[i][0] in limits:
                return

    while at < end:
        found = search(page, at)
        start = found.start() if found else end
        if start > at:
            stack[-1][1].children.append(page[at:start])
        if not found:
            break
        comment, slash, name, attributes = found.groups()
        if comment:
            stop = page.find("-->", start + 4)
            at = stop + 3 if stop >= 0 else end
            continue
        if not name:  # a declaration or an instruction
            stop = page.find(">", start)
            at = stop + 1 if stop >= 0 else end
            continue
        at, name = found.end(), name.lower()
        if slash:
            if stack[-1][0] == name:
                opened[name] -= 1
                del stack[-1]
                continue
            for i in range(len(stack) - 1, 0, -1) if opened[name] else ():
                if stack[i][0] == name:
                    close(i)
                    break
                if stack[i][0] in ("article", "table") and name not in BLOCKS:
                    break
            continue
        if name in CLOSED_BY_SAME:
            close_inside(*CLOSED_BY_SAME[name])
        if opened["p"] and name in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
        node = element(name, attributes, opened["article"] > 0)
        if name in RAW:
            stop = RAW_END[name].search(page, at)
            after = page.find(">", stop.end()) if stop else -1
            at = after + 1 if after >= 0 else end
            if name != "title":
                stack[-1][1].children.append(node)
            continue
        stack[-1][1].children.append(node)
        if name not in VOID:
            stack.append((name, node))
            opened[name] += 1
    return settle(root)


@dataclass(slots=True)
class Item:
    """A part of a wrapper: an element with its own parts, or a text that is a constant or a slot."""

    label: str  # "#text" for texts
    name: str = ""
    dropped: bool = False
    parts: list[Item] = field(default_factory=list)
    constant: str | None = None  # of a text; None is a slot
    common: frozenset[str] = frozenset()  # of a text: what stands here on all its pages
    size: int = 0  # of a text: characters on all its pages
    pages: int = 1
    optional: bool = False
    repeated: bool = False


def deep() -> None:
    """Let merge() and fold() follow any nesting: calls among Python functions take no C stack."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1 << 30))


def wrapper_of(root: Element) -> Item:
    """One page's wrapper, neighbours of one form already joined into repeated groups."""
    deep()
    done: list[list[Item]] = [[]]  # parts of the elements that are open
    todo: list[tuple[Element | str, bool]] = [(root, False)]
    while todo:
        node, inner_done = todo.pop()
        if isinstance(node, str):
            if text := tidy(node):
                done[-1].append(Item("#text", constant=text, common=frozenset([text]), size=len(text)))
        elif inner_done:
            parts = fold(done.pop())
            done[-1].append(Item(node.label, node.name, node.dropped, parts))
        else:
            done.append([])
            todo.append((node, True))
            todo += [(child, False) for child in reversed(node.children)]
    return done[0][0]


def fold(parts: list[Item]) -> list[Item]:
    """Join neighbours that repeat a form of one to three parts."""
    out: list[Item] = []
    for part in parts:
        out.append(part)
        while period := repeated_at_end(out):
            merged = [merge(a, b, True) for a, b in zip(out[-2 * period : -period], out[-period:], strict=True)]
            for item in merged:
                item.repeated = True
            out[-2 * period :] = merged
    return out


def repeated_at_end(parts: list[Item]) -> int:
    """How many of the last parts, one to three, have the labels of as many before; none: 0."""
    n, label = len(parts), parts[-1].label
    if n >= 2 and parts[-2].label == label != "#text":
        return 1
    if n >= 4 and parts[-3].label == label and parts[-4].label == parts[-2].label:
        return 2
    if n >= 6 and parts[-4].label == label and parts[-5].label == parts[-2].label and parts[-6].label == parts[-3].label:
        return 3
    return 0


def merge(a: Item, b: Item, same_page: bool = False) -> Item:
    """The wrapper that fits both."""
    pages = max(a.pages, b.pages) if same_page else a.pages + b.pages
    return Item(
        a.label,
        a.name,
        a.dropped and b.dropped,
        align(a.parts, b.parts, same_page) if a.parts or b.parts else [],
        a.constant if a.constant == b.constant else None,
        a.common | b.common if same_page else a.common & b.common,
        a.size + b.size,
        pages,
        a.optional or b.optional,
        a.repeated or b.repeated,
    )


def align(a: list[Item], b: list[Item], same_page: bool) -> list[Item]:
    """Match two sequences on their labels; what only one has becomes optional."""
    shorter = min(len(a), len(b))
    head = 0
    while head < shorter and a[head].label == b[head].label:
        head += 1
    if head == len(a) == len(b):
        return fold_optional([merge(x, y, same_page) for x, y in zip(a, b, strict=True)])
    tail = 0
    while tail < shorter - head and a[-1 - tail].label == b[-1 - tail].label:
        tail += 1
    out = [merge(x, y, same_page) for x, y in zip(a[:head], b[:head], strict=True)]
    rest_a, rest_b = a[head : len(a) - tail], b[head : len(b) - tail]
    i = j = 0
    for x, y in [*common([p.label for p in rest_a], [p.label for p in rest_b]), (len(rest_a), len(rest_b))]:
        out += [alone(p) for p in rest_a[i:x]] + [alone(p) for p in rest_b[j:y]]
        if x < len(rest_a):
            out.append(merge(rest_a[x], rest_b[y], same_page))
        i, j = x + 1, y + 1
    out += [merge(x, y, same_page) for x, y in zip(a[len(a) - tail :], b[len(b) - tail :], strict=True)]
    return fold_optional(out)


def alone(part: Item) -> Item:
    part.optional = True
    return part


def fold_optional(parts: list[Item]) -> list[Item]:
    """Neighbours of one label where one is optional or repeated are one repeated group."""
    out: list[Item] = []
    for part in parts:
        if out and part.label != "#text" and out[-1].label == part.label and (out[-1].repeated or part.repeated):
            out[-1] = merge(out[-1], part, same_page=True)
            out[-1].repeated = True
        else:
            out.append(part)
    return out


def common(a: list[str], b: list[str], cells: int = 1_000_000) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence; ``cells`` only decides how it is found."""
    if set(a).isdisjoint(b):
        return []
    if len(a) * len(b) > cells:
        return common_of_long(a, b)
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for x in range(len(a) - 1, -1, -1):
        row, below = best[x], best[x + 1]
        for y in range(len(b) - 1, -1, -1):
            row[y] = below[y + 1] + 1 if a[x] == b[y] else max(below[y], row[y + 1])
    out, x, y = [], 0, 0
    while x < len(a) and y < len(b):
        if a[x] == b[y]:
            out.append((x, y))
            x, y = x + 1, y + 1
        elif best[x + 1][y] >= best[x][y + 1]:
            x += 1
        else:
            y += 1
    return out


def matched_rows(a: list[str], b: list[str]) -> Iterator[int]:
    """After each label of ``a``, a number whose zero bits are where a longest match with b's start grows."""
    places: dict[str, int] = {}
    for y, label in enumerate(b):
        places[label] = places.get(label, 0) | 1 << y
    every = (1 << len(b)) - 1
    row = every
    for label in a:
        hit = row & places.get(label, 0)
        row = (row + hit | row - hit) & every
        yield row


def common_of_long(a: list[str], b: list[str], bits: int = 1 << 28) -> list[tuple[int, int]]:
    """A longest common subsequence by rows of bits; inputs whose rows pass ``bits`` are halved first."""
    if not a or not b:
        return []
    if len(a) * len(b) > bits and len(a) > 1:
        half = len(a) // 2

        def lengths(x: list[str], y: list[str]) -> list[int]:
            last = 0
            for last in matched_rows(x, y):
                pass
            return list(accumulate((1 - (last >> i & 1) for i in range(len(y))), initial=0))

        ahead, behind = lengths(a[:half], b), lengths(a[half:][::-1], b[::-1])[::-1]
        cut = max(range(len(b) + 1), key=lambda y: ahead[y] + behind[y])
        later = common_of_long(a[half:], b[cut:], bits)
        return common_of_long(a[:half], b[:cut], bits) + [(x + half, y + cut) for x, y in later]
    rows = list(matched_rows(a, b))
    out, x, y = [], len(a), len(b)
    while x and y:
        if rows[x - 1] >> (y - 1) & 1:
            y -= 1
        else:
            x -= 1
            if not x or rows[x - 1] >> (y - 1) & 1:
                y -= 1
                out.append((x, y))
    return out[::-1]


def infer(pages: list[str]) -> Item:
    """The wrapper of several pages, aligned one after the other."""
    wrapper = wrapper_of(parse(pages[0]))
    for page in pages[1:]:
        wrapper = merge(wrapper, wrapper_of(parse(page)))
    return wrapper


def expression(wrapper: Item) -> str:
    """A wrapper as text: constants quoted, slots as #text, groups with ?, + or *."""
    out: list[str] = []
    todo: list[Item | str] = [wrapper]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        mark = "*" if item.optional and item.repeated else "?" if item.optional else "+" if item.repeated else ""
        opening, closing = ("(", f"){mark}") if mark else ("", "")
        if item.label == "#text":
            inner = "#text" if item.constant is None else json.dumps(item.constant, ensure_ascii=False)
            out.append(opening + inner + closing)
            continue
        out.append(f"{opening}<{item.label}>")
        todo.append(f"</{item.name}>{closing}")
        for n, part in enumerate(reversed(item.parts)):
            todo += [" ", part] if n else [part]
    return "".join(out)


def packed(wrapper: Item) -> bytes:
    """A wrapper's parts in page order, each with the number of its own parts."""
    rows, todo = [], [wrapper]
    while todo:
        p = todo.pop()
        rows.append((p.label, p.name, p.dropped, p.constant, p.common, p.size, p.pages, p.optional, p.repeated, len(p.parts)))
        todo += reversed(p.parts)
    return zlib.compress(pickle.dumps(rows), 1)


def unpacked(data: bytes) -> Item:
    done: list[Item] = []  # the last one stands first on the page
    for label, name, dropped, constant, common, size, pages, optional, repeated, n in reversed(pickle.loads(zlib.decompress(data))):
        parts = done[len(done) - n :][::-1]
        del done[len(done) - n :]
        done.append(Item(label, name, dropped, parts, constant, common, size, pages, optional, repeated))
    return done[0]


def masses(wrapper: Item, left_out: set[int]) -> dict[int, int]:
    """Characters of slots outside links and dropped parts, by id of the part."""
    found: dict[int, int] = {}
    todo = [(wrapper, False)]
    while todo:
        item, inner_done = todo.pop()
        if item.dropped or item.name == "a" or id(item) in left_out:
            found[id(item)] = 0
        elif item.label == "#text":
            found[id(item)] = item.size if item.constant is None or item.pages == 1 else 0
        elif inner_done:
            found[id(item)] = sum(found[id(p)] for p in item.parts)
        else:
            todo.append((item, True))
            todo += [(p, False) for p in item.parts]
    return found


def labels(path: tuple | None) -> list[str]:
    """The labels of a path, which is a pair of the path before and a label."""
    out = []
    while path:
        path, label = path
        out.append(label)
    return out[::-1]


def holding_articles(wrapper: Item) -> set[int]:
    """Ids of the parts that have an article in them, outside dropped parts."""
    found: set[int] = set()
    todo: list[tuple[Item, tuple | None]] = [(wrapper, None)]
    while todo:
        item, above = todo.pop()
        if item.name == "article":
            up = above
            while up and id(up[1]) not in found:
                found.add(id(up[1]))
                up = up[0]
        here = (above, item)
        todo += [(p, here) for p in item.parts if not p.dropped]
    return found


def landmarks(wrapper: Item) -> tuple[list[list[str]], list[Item]]:
    """Paths and parts of the outermost articles, and of main elements that hold none."""
    named: dict[str, list[tuple[list[str], Item]]] = {"article": [], "main": []}
    holding = holding_articles(wrapper)
    todo: list[tuple[Item, tuple | None]] = [(wrapper, None)]
    while todo:
        item, path = todo.pop()
        if item.dropped:
            continue
        kind, here = "main" if item.label.endswith("@main") else item.name, (path, item.label)
        if kind == "article" or (kind == "main" and id(item) not in holding):
            named[kind].append((labels(here), item))
        else:
            todo += [(p, here) for p in item.parts if p.label != "#text"]
    both = named["article"] + named["main"]
    return [path for path, _ in both], [item for _, item in both]


def rules(wrapper: Item) -> dict:
    """Where articles stand (paths of labels) and which texts of the template stand among them.

    ``otherwise`` is the same for pages that have none of these places.
    """
    paths, items = landmarks(wrapper)
    if not paths:
        return containers(wrapper, set())
    found = {"main": paths, "constants": []}
    for path, item in zip(paths, items, strict=True):
        if has_template(item):
            add_constants(found["constants"], path, item, repeated=True)
    if sum(item.pages for item in items) < wrapper.pages:
        found["otherwise"] = containers(wrapper, set(map(id, items)))
    return found


def containers(wrapper: Item, left_out: set[int]) -> dict:
    """The places that hold most of what differs from page to page, one per template.

    A place is looked into as long as a container in it holds most, or several hold most on their
    own pages and stand for one another: together they are on no more pages than what they are in.
    A template's texts are those on all pages that have its place.
    """
    mass = masses(wrapper, left_out)
    if not mass[id(wrapper)] and (wrapper.pages > 1 or left_out):
        return {"main": [], "constants": []}  # nothing tells texts from the template
    main: list[list[str]] = []
    # Elements with the number of the one around them, their label and their texts of the template.
    constants: list[tuple[int, str, list[str]]] = []
    # With the mass and pages that shares are of: where the template starts, so that losses don't add up.
    places: list[tuple[Item, tuple, int, int]] = [(wrapper, (None, wrapper.label), mass[id(wrapper)], wrapper.pages)]
    while places:
        item, path, base, base_pages = places.pop()
        whole = mass[id(item)]
        inner, room = [], item.pages
        for p in sorted(item.parts, key=lambda p: -mass[id(p)]):
            held = p.name in CONTAINERS and not p.dropped and not p.repeated and mass[id(p)]
            if held and p.pages <= room and held * base_pages >= SHARE * base * p.pages:
                inner.append(p)
                room -= p.pages
        if sum(mass[id(p)] for p in inner) < SHARE * whole:
            inner = []
        if len(inner) == 1:
            places.append((inner[0], (path, inner[0].label), base, base_pages))
        else:
            places += [(p, (path, p.label), mass[id(p)], p.pages) for p in inner]
        if inner:
            continue
        if (found := labels(path)) not in main:
            main.append(found)
        if item.pages < 3 or not whole:
            continue
        add_constants(constants, found, item, repeated=has_template(item))
    return {"main": main, "constants": constants}


def add_constants(constants: list[tuple[int, str, list[str]]], path: list[str], item: Item, repeated: bool) -> None:
    """Add a place's elements with the texts that stand on all of its pages; ``repeated``: also beside others."""
    around = -1
    for label in path[:-1]:
        constants.append((around, label, []))
        around = len(constants) - 1
    todo = [(item, around)]
    while todo:
        part, around = todo.pop()
        here = [p for p in part.parts if p.label == "#text" and p.pages == item.pages]
        texts = {t for p in here for t in (p.common if repeated or p.constant is not None else ())}
        constants.append((around, part.label, sorted(texts)))
        todo += [(p, len(constants) - 1) for p in part.parts if p.label != "#text"]


def has_template(item: Item) -> bool:
    """Whether what many pages of a place have in common is little enough to be a template's."""
    constant = text = 0
    todo = [item]
    while todo:
        part = todo.pop()
        if part.label == "#text":
            text += part.size
            constant += sum(map(len, part.common)) * part.pages if part.pages == item.pages else 0
        elif not part.dropped:
            todo += part.parts
    return item.pages >= TEMPLATE_PAGES and 0 < constant <= TEMPLATE_SHARE * text


def tidy(text: str) -> str:
    """Character references decoded, white space runs as one blank, none at the ends."""
    return " ".join((html.unescape(text) if "&" in text else text).split())


@dataclass(slots=True)
class Step:
    """Where a path of labels leads."""

    inner: dict[str, Step] = field(default_factory=dict)
    place: bool = False
    constants: set[str] = field(default_factory=set)


def steps_of(found: dict) -> Step:
    """Paths as nested steps by label: whether a place stands there, and its texts of the template."""
    top = Step()
    for path in found["main"]:
        step = top
        for label in path:
            step = step.inner.setdefault(label, Step())
        step.place = True
    steps: list[Step] = []
    for around, label, texts in found["constants"]:
        steps.append((steps[around] if around >= 0 else top).inner.setdefault(label, Step()))
        steps[-1].constants.update(texts)
    return top


def readings(found: dict | None) -> list[Step]:
    """The steps of a host's rules and of those for pages that have none of their places."""
    out = []
    while found:
        out.append(steps_of(found))
        found = found.get("otherwise")
    return out


def main_text(root: Element, top: Step) -> str | None:
    """The blocks of a page's articles, joined by line ends; None if the page has no such place."""
    blocks: list[str] = []
    pieces: list[str] = []
    fits = False

    def finish() -> None:
        if pieces:
            if text := " ".join("".join(pieces).split()):
                blocks.append(text)
            pieces.clear()

    # Work still to do, last first: elements with their step, texts, and ends of blocks.
    todo: list = [(root, top.inner.get(root.label), False)]
    while todo:
        node, step, inside = todo.pop()
        if node is None:
            finish()
        elif node.__class__ is str:
            if inside and not (step and step.constants and tidy(node) in step.constants):
                # A reference ends with its text: what stands in the next element isn't part of it.
                pieces.append(html.unescape(node) if "&" in node else node)
        elif node.dropped:
            if pieces and node.name in BLOCKS:
                finish()
        elif not (inside or step or pieces):
            pass  # no place is in here, and there is no block to end
        elif node.name == "br":
            if inside:
                pieces.append(" ")
        else:
            if step and step.place:
                inside = fits = True
            if node.name in BLOCKS:
                finish()
                todo.append((None, None, False))
            for child in reversed(node.children):
                if child.__class__ is str:
                    if inside:
                        todo.append((child, step, True))
                else:
                    todo.append((child, step and step.inner.get(child.label), inside))
    finish()
    return "\n".join(blocks) if fits else None


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://([^/?#]*)", 1)), F.lit(""))


def hinted(df: DataFrame, columns: list[str], broadcast_bytes: int) -> DataFrame:
    """The table, kept, and broadcast if the columns are small."""
    kept = cut_lineage(df)
    size = kept.agg(F.sum(sum(F.length(c) for c in columns))).first()[0] or 0
    return F.broadcast(kept) if size <= broadcast_bytes else kept


def infer_wrappers(
    df: DataFrame,
    *,
    group_pages: int = GROUP_PAGES,
    broadcast_bytes: int = BROADCAST_BYTES,
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """(host, pages, wrapper, rules): a wrapper per host, from all its different pages.

    Pages are dealt to groups by their digest, so that copies meet and the order of the alignment
    doesn't depend on how the table is cut into tasks.
    """
    rows = df.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    counts = rows.groupBy("host").count().where(F.col("count") > group_pages)
    groups = hinted(counts.select("host", F.ceil(F.col("count") / group_pages).alias("groups")), ["host"], broadcast_bytes)
    most = groups.agg(F.max("groups")).first()[0] or 1
    rows = rows.where("html IS NOT NULL").join(groups, "host", "left")
    rows = rows.withColumn("digest", F.unhex(F.sha2("html", 256)))
    part = F.pmod(F.xxhash64("digest"), F.coalesce("groups", F.lit(1))).alias("part")
    rows = rows.select("host", part, "digest", "html")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Leave out a task's copies; those of other tasks meet in the group."""
        seen = set()
        for batch in batches:
            fresh = []
            for key in zip(batch.column("host").to_pylist(), batch.column("digest").to_pylist(), strict=True):
                fresh.append(key not in seen)
                seen.add(key)
            yield batch.filter(pa.array(fresh, pa.bool_()))

    def align_pages(frame: pd.DataFrame) -> pd.DataFrame:
        pages = frame.drop_duplicates("digest").sort_values("digest")["html"].tolist()
        row = [frame["host"].iloc[0], frame["part"].iloc[0], packed(infer(pages))]
        return pd.DataFrame([row], columns=["host", "part", "wrapper"])

    def align_wrappers(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        data = frame["wrapper"].iloc[0]
        if len(frame) > 1:
            deep()
            wrapper = unpacked(data)
            for other in frame["wrapper"].iloc[1:]:
                wrapper = merge(wrapper, unpacked(other))
            data = packed(wrapper)
        row = [frame["host"].iloc[0], frame["part"].iloc[0] // group_pages, data]
        return pd.DataFrame([row], columns=["host", "part", "wrapper"])

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = list(map(unpacked, frame["wrapper"]))
            yield pd.DataFrame(
                {
                    "host": frame["host"],
                    "pages": [w.pages for w in found],
                    "wrapper": list(map(expression, found)),
                    "rules": [json.dumps(rules(w)) for w in found],
                }
            )

    schema = "host string, part long, wrapper binary"
    aligned = rows.mapInArrow(once, rows.schema).groupBy("host", "part").applyInPandas(align_pages, schema)
    while most > 1:
        upper = F.floor(F.col("part") / group_pages)
        aligned = aligned.groupBy("host", upper).applyInPandas(align_wrappers, schema)
        most = -(-most // group_pages)
    return aligned.mapInPandas(finish, "host string, pages long, wrapper string, rules string")


def read_page(page: str | None, host_rules: dict | None) -> str:
    return read_by(page, readings(host_rules))


def read_by(page: str | None, host_steps: list[Step]) -> str:
    """A page's text by the first steps that fit it, or else by its own wrapper."""
    if not page:
        return ""
    root = parse(page)
    for top in host_steps:
        text = main_text(root, top)
        if text is not None:
            return text
    return main_text(root, steps_of(rules(wrapper_of(root)))) or ""


def extract_main_text(
    df: DataFrame,
    *,
    group_pages: int = GROUP_PAGES,
    broadcast_bytes: int = BROADCAST_BYTES,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """(id, url, text, n_chars): every page's main text by its host's wrapper.

    A null or empty page has an empty text. Pages without a host in their url share a wrapper.
    Repeated rows and ids are read like any other; an empty table gives no rows; other columns are
    ignored, whatever their names. Infers the wrappers eagerly.
    """
    found = infer_wrappers(
        df, group_pages=group_pages, broadcast_bytes=broadcast_bytes, url_col=url_col, html_col=html_col
    )
    wrappers = hinted(found.select("host", "rules"), ["rules", "host"], broadcast_bytes)
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    paired = rows.withColumn("host", host_of(F.col("url"))).join(wrappers, "host", "left")

    @F.pandas_udf("string")
    def read(pages: pd.Series, found: pd.Series) -> pd.Series:
        steps = {r: readings(json.loads(r)) for r in found.dropna().unique()}
        return pd.Series([read_by(p, steps.get(r, [])) for p, r in zip(pages, found, strict=True)], dtype="object")

    texts = paired.select("id", "url", read("html", "rules").alias("text"))
    return texts.select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars")
    )
