"""HTML extraction by union-free wrapper inference over the pages of a host.

A page becomes a stream of tags and texts, nested as its elements are. Neighbours of one kind, and runs of several kinds that come
again, fold into repeated groups, which gives the page's own expression. The expressions of a host are aligned one by one: tokens
that match stay, tokens that one side lacks become optional, repeated ones become groups, and texts that differ become slots. The
result, the host's wrapper, is an expression without unions. It says where the host's content is (the container), and which texts
beside slots never change.

Pages of one shape first add up, in each task and then by shape. Shapes are aligned in the order of their text, ``FAN`` to a task
in as many levels as a host needs, so wrappers don't depend on how pages are dealt out, and no task holds a host. A page is then
read through its host's wrapper; a page that doesn't fit is read through its own.

Texts in an article are read from the page's own tree, without elements that are marked as something else. Below ``DEEP`` open
elements, further ones aren't nested any more; their texts and their breaks stay. A wrapper of more than ``WRAPPER_NODES`` nodes
tells elements by their tags only.

Defined results: null and empty pages give the empty text; a null or odd URL belongs to the host ''; repeated rows and pages of one
text give equal texts, and never count as a host's unchanging frame by themselves; a quote that is never closed is an ordinary
character; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Fixed lists of HTML: elements without content, elements whose content is no markup, inline elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math object title".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: What closes an open <p>, <li> and the like without an end tag.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Elements, and words of classes, ids and roles, that mark what isn't main text.
SKIP_TAGS = frozenset("nav header footer aside form button select dialog menu fieldset".split())
SKIP_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer contentinfo sidebar complementary aside ad ads advert adverts "
    "advertisement advertising adslot banner promo sponsor sponsored cookie cookies consent notice notices popup modal overlay newsletter subscribe "
    "subscription signup login comment comments reply replies disqus respond share sharing social related recommended search pagination pager skip toolbar widget".split()
)
#: Words that say nothing about what a compound label marks.
NEUTRAL_WORDS = frozenset("site page top bottom left right main global primary secondary box block list item items posts links link buttons button bar section wrap wrapper container inner outer area panel post entry form icons icon text js 0".split())
HEADER_WORDS = frozenset(("header", "masthead"))
CONTENT = ("article", "main")
#: A text beside slots that stands unchanged in so many pages of a host, in all that have it and outside an article, isn't a page's own.
CONSTANT_PAGES = 8
#: Open elements below which others aren't nested, and nodes of a wrapper above which elements go by their tags.
DEEP, WRAPPER_NODES = 100, 3000
#: Kinds in a run that is sought again right after it; cells of an alignment's table, beyond which matches are taken as they come.
PERIOD, CELLS = 6, 200_000
#: Nodes that a task holds before it sends them on; shapes that one task aligns.
HELD_NODES, FAN = 200_000, 1000
#: Bytes of all plans up to which they are broadcast.
BROADCAST_BYTES = 16 << 20

_OPEN = re.compile(r"<(?:(/?)([A-Za-z][A-Za-z0-9:-]*)|!--|[!?/])")
_STOP = re.compile(r">|=\s*[\"']")
_LABEL = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_DIGITS = re.compile(r"\d+")
_PARTS = re.compile(r"[-_:]+")


def _marks(label: str) -> set[str]:
    """The words by which a label marks what isn't main text; none if it also holds words of its own."""
    parts = {p for p in _PARTS.split(label) if p}
    return parts & SKIP_WORDS if parts <= SKIP_WORDS | NEUTRAL_WORDS else set()


class Node:
    """An element: ``key`` is its tag with the words of its class, id and role, digits blanked; ``title`` says that it holds an h1."""

    __slots__ = ("tag", "key", "marks", "children", "title")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.children, self.title = tag, [], False
        words = set()
        if attributes:
            for m in _LABEL.finditer(attributes):
                words.update(_DIGITS.sub("0", (m[2] or m[3] or m[4] or "").lower()).split())
        self.key = tag + "".join("." + w for w in sorted(words)[:4])
        self.marks = {m for w in words for m in _marks(w)} if words else words

    @property
    def skipped(self) -> bool:
        return self.tag in SKIP_TAGS or (self.tag not in CONTENT and bool(self.marks))

    @property
    def heads(self) -> bool:
        """Whether it is a header with the title in it."""
        return self.title and (self.tag == "header" or self.tag not in SKIP_TAGS) and self.marks <= HEADER_WORDS


def _tag_end(page: str, at: int, quotes: bool) -> int:
    """Where the tag whose name ends at ``at`` ends; a quote opens a value right after an equals sign only. -1 if it doesn't end."""
    while quotes:
        m = _STOP.search(page, at)
        if not m or m[0] == ">":
            return m.start() if m else -1
        at = page.find(m[0][-1], m.end()) + 1
        if not at:
            return -1
    return page.find(">", at)


def markup(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(text before, slash of an end tag, tag in lower case, attributes) of each tag, and the last text with an empty tag.

    Comments, declarations and elements whose content is no markup are left out. Every step moves on, so time is linear.
    """
    at = pos = 0
    quotes = True
    while m := _OPEN.search(page, pos):
        if m[2]:
            end = _tag_end(page, m.end(), quotes)
            if end < 0 and quotes:
                quotes, end = False, page.find(">", m.end())
            if end < 0:
                break
            tag, attributes = m[2].lower(), page[m.end() : end]
            yield page[at : m.start()], m[1], tag, attributes
            at = pos = end + 1
            if tag in RAW and not m[1] and not attributes.endswith("/"):
                close = _raw_end(tag).search(page, pos)
                end = page.find(">", close.end()) if close else -1
                at = pos = end + 1 if end >= 0 else len(page)
            continue
        closer = "-->" if m[0] == "<!--" else ">"
        end = page.find(closer, m.end())
        if end < 0 and closer == ">":
            break
        yield page[at : m.start()], "", "!", ""
        at = pos = end + len(closer) if end >= 0 else len(page)
    yield page[at:], "", "", ""


@cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\b", re.I)


def parse(page: str) -> Node:
    """The body of a page as a tree; texts are strings with references decoded.

    The stack holds all open elements; those beyond DEEP have no place in the tree, but hide what is below them if they are skipped.
    """
    root = Node("body")
    stack, blocks_at, open_ = [root], [0], Counter()
    hidden = 0  # the place of the outermost skipped element that isn't in the tree, 0 if there is none

    def cut(k: int) -> None:
        nonlocal hidden
        for node in stack[k:]:
            open_[node.tag] -= 1
        if len(stack) > DEEP and any(n.tag not in INLINE for n in stack[max(k, DEEP) :]):
            stack[DEEP - 1].children.append(Node("div"))
        del stack[k:], blocks_at[k:]
        if hidden >= k:
            hidden = 0

    def find(tags, fence=()) -> int:
        """The place of the innermost open element of ``tags`` above a fence, or 0."""
        if not any(open_[t] > 0 for t in tags):
            return 0
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in fence:
                return 0
            if stack[k].tag in tags:
                return k
        return 0

    for text, slash, tag, attributes in markup(page):
        if text and not hidden:
            stack[min(len(stack), DEEP) - 1].children.append(entities.unescape(text))
        if tag in ("", "!"):
            continue
        if slash:
            if k := find((tag,)):
                cut(k)
            continue
        if tag in ("html", "head", "body"):
            if tag == "body":
                cut(1)
                root.children.clear()
            continue
        if tag in RAW and not attributes.endswith("/"):
            continue
        if tag not in INLINE and stack[k := blocks_at[-1]].tag == "p" and k:
            cut(k)
        if tag in CLOSES and (k := find(CLOSES[tag], FENCES[tag])):
            cut(k)
        node = Node(tag, attributes)
        if tag == "h1":
            for n in stack[:DEEP]:
                n.title = True
        if len(stack) < DEEP:
            stack[-1].children.append(node)
        elif tag not in INLINE and not hidden:
            stack[DEEP - 1].children.append(Node("br" if tag == "br" else "div"))
        if tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
            blocks_at.append(blocks_at[-1] if tag in INLINE else len(stack) - 1)
            open_[tag] += 1
            if len(stack) > DEEP and node.skipped and not hidden:
                hidden = len(stack) - 1
    return root


# An expression is a list of items. An item is [key, times, pages, chars, text, items]: times is "1", "?", "+" or "*"; pages
# counts the pages that have it; chars is the text below it; text is a text item's constant, or None for a slot. A group of
# several kinds has the key "(kinds)" and is no element: its items stand where it does.
TEXT = "#"


def _is_group(key: str) -> bool:
    return key.startswith("(")


def _joint(a: str, b: str) -> str:
    more, less = a in "+*" or b in "+*", a in "?*" or b in "?*"
    return "*" if more and less else "+" if more else "?" if less else "1"


def expression(node: Node) -> list:
    """The page's own expression of a node: neighbours of one kind, and runs that come again, folded into repeated groups."""
    out: list = []
    for child in node.children:
        if isinstance(child, str):
            text = " ".join(child.split())
            if not text:
                continue
            item = [TEXT, "1", 1, len(text), text, []]
        elif child.tag == "br":
            continue
        else:
            inner = expression(child)
            item = [child.key, "1", 1, sum(i[3] for i in inner), None, inner]
        _put(out, item)
    return _runs(out)


def _put(out: list, item: list) -> None:
    """Add an item, or fold it into the last one of its kind."""
    if not out or out[-1][0] != item[0]:
        out.append(item)
        return
    last = out[-1]
    out[-1] = _united(last, item, True)
    out[-1][1] = "*" if "?" in (last[1], item[1]) and last[1] in "?*" and item[1] in "?*" else "+"


def _runs(items: list) -> list:
    """Runs of up to PERIOD kinds that come again right after themselves, as groups."""
    if len(items) < 4:
        return items
    keys, out, k = [i[0] for i in items], [], 0
    while k < len(items):
        for p in range(2, PERIOD + 1):
            end = k + p
            while keys[end : end + p] == keys[k : k + p]:
                end += p
            if end > k + p:
                body = items[k : k + p]
                for at in range(k + p, end, p):
                    body = [_united(x, y, True) for x, y in zip(body, items[at : at + p])]
                out.append(_group(body, "+"))
                k = end
                break
        else:
            out.append(items[k])
            k += 1
    return out


def _group(body: list, times: str) -> list:
    return [f"({' '.join(i[0] for i in body)})", times, max(i[2] for i in body), sum(i[3] for i in body), None, body]


def _united(a: list, b: list, same_page: bool = False) -> list:
    """Both items as one; ``same_page``: they stand in the same pages."""
    text = a[4] if a[0] == TEXT and a[4] == b[4] else None
    return [a[0], _joint(a[1], b[1]), max(a[2], b[2]) if same_page else a[2] + b[2], a[3] + b[3], text, align(a[5], b[5], same_page)]


def _matches(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places with equal keys, ascending on both sides: a longest common subsequence.

    Where its table would have more than CELLS cells, each key takes the next place that has it, if that is near.
    """
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    n, m = len(a), len(b)
    while n > low and m > low and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    head, tail = [(k, k) for k in range(low)], [(n + k, m + k) for k in range(len(a) - n)]
    x, y = a[low:n], b[low:m]
    out: list[tuple[int, int]] = []
    if len(x) * len(y) <= CELLS:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            row, below = best[i], best[i + 1]
            for j in range(len(y) - 1, -1, -1):
                row[j] = below[j + 1] + 1 if x[i] == y[j] else max(below[j], row[j + 1])
        i = j = 0
        while i < len(x) and j < len(y):
            if x[i] == y[j]:
                out.append((i + low, j + low))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    else:
        places: dict[str, list[int]] = {}
        for j, key in enumerate(y):
            places.setdefault(key, []).append(j)
        at, near = 0, max(16, abs(len(x) - len(y)) + 16)
        for i, key in enumerate(x):
            found = places.get(key, [])
            k = bisect_left(found, at)
            if k < len(found) and found[k] - at <= near:
                out.append((i + low, found[k] + low))
                at = found[k] + 1
    return head + out + tail


def _regrouped(items: list, others: list) -> list:
    """The items with each run that is a group of ``others``, once, as that group."""
    mine = {i[0] for i in items}
    for g in others:
        if not _is_group(g[0]) or g[0] in mine:
            continue
        wanted, k = [i[0] for i in g[5]], 0
        while k + len(wanted) <= len(items):
            if [i[0] for i in items[k : k + len(wanted)]] == wanted:
                items = [*items[:k], _group(items[k : k + len(wanted)], "1"), *items[k + len(wanted) :]]
            k += 1
    return items


def align(a: list, b: list, same_page: bool = False) -> list:
    """One expression for both: what matches is united, the rest is optional."""
    if not a or not b:
        return [_optional(i) for i in a or b]
    if any(_is_group(i[0]) for i in a) or any(_is_group(i[0]) for i in b):
        a, b = _regrouped(a, b), _regrouped(b, a)
    out: list = []
    i = j = 0
    for x, y in [*_matches([k[0] for k in a], [k[0] for k in b]), (len(a), len(b))]:
        for item in [*a[i:x], *b[j:y]]:
            _put(out, _optional(item))
        if x < len(a):
            _put(out, _united(a[x], b[y], same_page))
        i, j = x + 1, y + 1
    return out


def _optional(item: list) -> list:
    return [item[0], _joint(item[1], "?"), *item[2:]]


def _nodes(items: list) -> int:
    n, todo = 0, [items]
    while todo:
        at = todo.pop()
        n += len(at)
        todo.extend(i[5] for i in at if i[5])
    return n


def bare(items: list) -> list:
    """The expression with elements told by their tags only; those of one tag at one place are one item, at the first one's."""
    out: dict[str, list] = {}
    flat = [x for i in items for x in ([_optional(y) for y in i[5]] if _is_group(i[0]) else [i])]
    for key, times, pages, chars, text, inner in flat:
        item = [key.partition(".")[0], times, pages, chars, text, bare(inner)]
        old = out.get(item[0])
        out[item[0]] = item if old is None else [item[0], "*", max(old[2], pages), old[3] + chars, old[4] if old[4] == text else None, bare(align(old[5], item[5], True))]
    return list(out.values())


def aligned(expressions: list[list], loose: bool = False) -> tuple[list, bool]:
    """The wrapper of the expressions, and whether it tells elements by their tags only."""
    out: list | None = None
    for e in expressions:
        e = bare(e) if loose else e
        out = e if out is None else align(out, e)
        if not loose and _nodes(out) > WRAPPER_NODES:
            out, loose = bare(out), True
    return out or [], loose


def shape(items: list) -> str:
    """An expression's keys and times as text."""
    return "".join(f"{i[0]}{i[1]}[{shape(i[5])}]" for i in items)


def _added(a: list, b: list) -> list:
    """Two expressions of one shape, their counts added up."""
    return [[x[0], x[1], x[2] + y[2], x[3] + y[3], x[4] if x[4] == y[4] else None, _added(x[5], y[5])] for x, y in zip(a, b)]


def _skip(key: str) -> bool:
    return Node(*_split_key(key)).skipped


def _split_key(key: str) -> tuple[str, str]:
    tag, _, labels = key.partition(".")
    return tag, f' class="{labels.replace(".", " ")}"' if labels else ""


def container(wrapper: list) -> list[str]:
    """The keys from the body down to the element that holds the main text."""
    found: list[tuple[int, list[str], str]] = []

    def look(items: list, path: list[str], again: bool) -> None:
        for key, times, _, chars, _, inner in items:
            if _is_group(key):
                look(inner, path, True)
                continue
            if key == TEXT or _skip(key):
                continue
            if key.partition(".")[0] in CONTENT:
                found.append((chars, [*path, key], "+" if again else times))
            look(inner, [*path, key], False)

    look(wrapper, [], False)
    articles = [f for f in found if f[1][-1].startswith("article")]
    once = [f for f in articles if f[2] in "1?"]
    pick = once if len(articles) == len(once) else [(c, p[:-1], t) for c, p, t in articles if t in "+*"]
    pick = pick or [f for f in found if not f[1][-1].startswith("article")]
    if pick:
        return max(pick, key=lambda f: f[0])[1]
    # Else down while one element holds most of the text that isn't skipped, and does so as blocks.
    path: list[str] = []
    items = wrapper
    while True:
        open_ = [i for i in items if i[0] == TEXT or not _skip(i[0])]
        total = sum(i[3] for i in open_)
        top = max(open_, key=lambda i: i[3], default=None)
        if not top or top[0] == TEXT or _is_group(top[0]) or top[1] in "+*" or top[3] < 0.7 * total or top[0].partition(".")[0] not in ("div", "section", "table", "tbody", "tr", "td", "center"):
            return path
        path.append(top[0])
        items = top[5]


def _elements(items: list) -> Iterator[list]:
    """The items, with those of groups in the groups' places."""
    for i in items:
        if _is_group(i[0]):
            yield from _elements(i[5])
        else:
            yield i


def plan(wrapper: list, loose: bool = False) -> dict:
    """What extraction needs of a wrapper: the container's path, and its constant texts with the keys above them."""
    path, items = container(wrapper), wrapper
    for key in path:
        items = next(i[5] for i in _elements(items) if i[0] == key)
    constant: list[list[str]] = []
    slots = 0

    def look(inner: list, above: str) -> None:
        nonlocal slots
        for key, _, pages, _, text, below in _elements(inner):
            if key != TEXT:
                look(below, f"{above}/{key}")
            elif text is None:
                slots += 1
            elif pages >= CONSTANT_PAGES:
                constant.append([above, text])

    if not path or path[-1].partition(".")[0] not in CONTENT:  # what stands in an article is its own
        look(items, "")
    # Without a slot, all pages are copies of one, and what they share is their text.
    return {"path": path, "constant": constant if slots else [], "loose": loose}


def blocks(page: Node, by: dict) -> list[str]:
    """The blocks of main text, in page order."""
    named = (lambda n: n.tag) if by.get("loose") else (lambda n: n.key)
    level = [page]
    for key in by["path"]:
        level = [c for n in level for c in n.children if isinstance(c, Node) and named(c) == key]
    if not level:
        own = plan(expression(page))
        return blocks(page, own) if own["path"] != by["path"] or by.get("loose") else []
    constant = {tuple(c) for c in by["constant"]}
    in_article = bool(by["path"]) and by["path"][-1].partition(".")[0] in CONTENT
    out: list[str] = []
    dropped: list[tuple[int, str]] = []
    held: list[str] = []
    places: list[str] = []

    def end() -> None:
        text = " ".join("".join(held).split())
        whole = len(places) == 1 and (places[0], text) in constant  # a block of one unchanging text
        held.clear()
        places.clear()
        if text and whole:
            dropped.append((len(out) + len(dropped), text))
        elif text:
            out.append(text)

    def walk(node: Node, above: str) -> None:
        for child in node.children:
            if isinstance(child, str):
                held.append(child)
                if constant and child.strip():
                    places.append(above)
            elif child.tag == "br":
                held.append(" ")
            elif not child.skipped or (in_article and child.heads):
                block = child.tag not in INLINE
                if block:
                    end()
                walk(child, f"{above}/{named(child)}" if constant else above)
                if block:
                    end()

    for node in level:
        end()
        walk(node, "")
        end()
    return out or [text for _, text in dropped]  # a page whose every text is the host's has no other text


_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def _rows(pages: DataFrame, page_id: str, url: str, page: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url}`"), F.lit("")), _HOST, 1))
    return pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), host.alias("host"), F.coalesce(F.col(f"`{page}`"), F.lit("")).alias("html"))


def wrappers(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(host, plan, wrapper) of each host, the last two as JSON."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list] = {}
        size = 0

        def sent() -> pa.RecordBatch:
            rows = [(h, s, json.dumps([e, False])) for (h, s), e in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows)], names=["host", "shape", "e"])

        for batch in batches:
            for host, body in zip(batch.column(0), batch.column(1)):
                e = expression(parse(body.as_py()))
                key = (host.as_py(), hashlib.md5(shape(e).encode()).hexdigest())
                if key in held:
                    held[key] = _added(held[key], e)
                else:
                    held[key] = e
                    size += 1 + _nodes(e)
                if size > HELD_NODES:
                    yield sent()
                    size = 0
        if held:
            yield sent()

    def together(frame):
        import pandas as pd

        return pd.DataFrame({"host": [frame["host"].iloc[0]], "shape": [frame["shape"].min()], "e": [json.dumps(_wrapped(frame))]})

    def planned(frame):
        import pandas as pd

        wrapper, loose = _wrapped(frame)
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "plan": [json.dumps(plan(wrapper, loose))], "wrapper": [json.dumps(wrapper)]})

    parts = stored(_rows(pages, page_id, url, page).select("host", "html").mapInArrow(own, "host string, shape string, e string"), "shapes")
    while True:
        # Rows of one shape go to one part; how many parts there are rests on the shapes only.
        sizes = parts.groupBy(F.col("host").alias("s_host")).agg(F.count_distinct("shape").alias("shapes"))
        big = sizes.where(F.col("shapes") > FAN).limit(1).count()
        if not big:
            break
        many = parts.join(sizes, F.col("host") == F.col("s_host")).withColumn("part", F.pmod(F.xxhash64("shape"), F.ceil(F.col("shapes") / FAN)))
        parts = stored(many.groupBy("host", "part").applyInPandas(together, "host string, shape string, e string"), "shapes")
    return parts.groupBy("host").applyInPandas(planned, "host string, plan string, wrapper string")


def _wrapped(frame) -> tuple[list, bool]:
    """The wrapper of a frame's expressions (shape, e): those of one shape add up, then all are aligned in the shapes' order."""
    by_shape: dict[str, list] = {}
    any_loose = False
    for s, e in sorted(zip(frame["shape"], frame["e"])):
        items, loose = json.loads(e)
        any_loose = any_loose or loose
        by_shape[s] = _added(by_shape[s], items) if s in by_shape else items
    return aligned([by_shape[s] for s in sorted(by_shape)], any_loose)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    plans = stored(wrappers(pages, page_id, url, page), "wrappers").select(F.col("host").alias("p_host"), "plan")
    bytes_ = plans.agg(F.sum(F.octet_length("plan") + F.octet_length("p_host"))).first()[0] or 0
    rows = _rows(pages, page_id, url, page)
    rows = rows.join(F.broadcast(plans) if bytes_ <= BROADCAST_BYTES else plans, F.col("host") == F.col("p_host"), "left").select("page_id", "url", "plan", "html")
    schema = rows.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for by, body in zip(batch.column(2), batch.column(3)):
                by = by.as_py()
                if by not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[by] = json.loads(by) if by else {"path": [], "constant": [], "loose": False}
                texts.append("\n".join(blocks(parse(body.as_py()), known[by])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(read, schema)
