"""Main text of web pages through wrappers inferred per host.

A page is a tree of elements. Pages of one host are aligned tree by tree:
equal elements are merged, neighbours of one kind become a repeated group, an
element that some pages lack becomes optional, and text that differs between
pages becomes a slot; text that all pages have at one place stays a constant. The
result is a union-free regular expression, the host's wrapper. Partial wrappers
are built where the pages are and merged per host in two steps, so a host of
any size meets nowhere as pages.

The wrapper names the element that holds a host's article: where its slots
hold most text outside menus, notices and the like. Each page's text is then
read below that element, without the constants, which belong to the template;
pages that do not have the element use their own best. Constants are left in
where a host has fewer than ``TEMPLATE_PAGES`` different pages, or where they
are more than a fifth of the article: such pages are copies, not a template.

Defined cases: null or empty html gives empty text; a null or malformed address
is a host of its own; broken markup is read as far as it goes; very deep or wide
markup is described coarsely in the wrapper and read whole; repeated rows give
repeated results; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apptlens.llm.common import known

# Elements whose text is never content, elements without an end,
# elements that start a block of text, elements whose start ends one of the
# same kind.
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "canvas", "math", "xmp"}
UNSEEN = RAW | {"head", "title", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th"
    " thead tr ul caption option".split()
)
CLOSES = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
}
ENDS_P = BLOCKS - {"body", "html"}
# Elements beyond which a start or end tag does not reach when it closes others.
SCOPES = {"table", "ul", "ol", "dl", "article", "section", "main", "div", "aside", "nav", "footer", "header", "body", "html", "td", "th", "form"}

# Words in class, id or role that mark what is not content.
MARKS = set(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored sponsors breadcrumb"
    " breadcrumbs comment comments respond replies disqus cookie cookies consent gdpr notice notices alert popup modal"
    " overlay newsletter subscribe subscription signup login menu nav navbar navigation topbar toolbar masthead sidebar"
    " side widget widgets footer copyright pagination pager related recommended recommendations share sharing social"
    " skip hidden complementary contentinfo search banner-ad outbrain taboola".split()
)
QUALIFIED = {"with", "has", "no", "without"}
PAGE_HEADERS = {"header", "site-header", "page-header", "siteheader", "pageheader"}
CONTENT = {"article", "main"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?|<[!?][^>]*>?", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_MARK_WORD = re.compile(r"[a-z]+")


class Node:
    """An element: its name with its class words, its children (elements and texts)."""

    __slots__ = ("tag", "key", "skipped", "children")

    def __init__(self, tag: str, key: str, skipped: bool):
        self.tag, self.key, self.skipped, self.children = tag, key, skipped, []


def _described(tag: str, attributes: str, parent: Node) -> Node:
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
    named = [w for a in ("class", "id", "role") for w in re.split(r"[\s]+", found.get(a, "").lower()) if w]
    # Numbers in names count pages, not kinds.
    key = ".".join([tag, *sorted({re.sub(r"\d+", "0", w) for w in named})])
    # "with-sidebar" names what stands beside, not the element.
    parts = {p for w in named for p in ((w,) if QUALIFIED & set(w.split("-")) else (w, *_MARK_WORD.findall(w)))}
    if PAGE_HEADERS & set(named):
        parts.add("masthead")
    skipped = tag in UNSEEN or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    skipped |= tag not in ("html", "body", "main") and bool(parts & MARKS) and not (tag == "article" and not parts & {"comment", "ad", "promo", "related"})
    # A header is the page's own unless it stands in the article.
    skipped |= tag == "header" and parent.tag not in ("article", "main", "section")
    return Node(tag, key, skipped)


def parse(html: str) -> Node:
    """The tree of a page. Never fails: stray ends are dropped, open elements end with the page."""
    root = Node("", "", False)
    stack, at, n = [root], 0, len(html)

    def close(tags: set[str], scope: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in scope:
                return

    for token in _TOKEN.finditer(html):
        if token.start() < at:
            continue
        if token.start() > at:
            stack[-1].children.append(html[at : token.start()])
        at = token.end()
        if not token[2]:
            continue
        tag = token[2].lower()
        if token[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag not in ("article", "main", "body", "html", "nav", "footer", "aside", "section", "div", "table", "form") and stack[k].tag in SCOPES:
                    break
            continue
        if tag in CLOSES:
            for closed in CLOSES[tag]:
                close({closed}, SCOPES - {closed})
        elif tag in ENDS_P:
            close({"p"}, SCOPES)
        node = _described(tag, token[3], stack[-1])
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
            at = n if end is None else html.find(">", end.start()) + 1 or n
        elif tag not in VOID and not (token[3] or "").rstrip().endswith("/"):
            stack.append(node)
    if at < n:
        stack[-1].children.append(html[at:])
    return root


def blocks(node: Node) -> list[str]:
    """The text below an element, block by block, without what is skipped."""
    out, run = [], []

    def end() -> None:
        text = " ".join(unescape("".join(run)).split())
        run.clear()
        if text:
            out.append(text)

    def walk(top: Node) -> None:
        todo: list = [top]
        while todo:
            item = todo.pop()
            if item is None:
                end()
            elif isinstance(item, str):
                run.append(item)
            elif item.skipped and item is not top:
                if item.tag in BLOCKS:
                    end()
            elif item.tag in BLOCKS and item is not top:
                end()
                todo.append(None)
                todo += reversed(item.children)
            else:
                if item.tag == "br":
                    run.append(" ")
                todo += reversed(item.children)

    walk(node)
    end()
    return out


# A wrapper is nested lists: [key, flags, characters, constants, children]. The
# constants are the hashes of the element's own texts that every page has, with
# their characters; what is beyond them are slots.
# flags: 1 optional, 2 repeated, 4 skipped.
OPTIONAL, REPEATED, SKIPPED = 1, 2, 4
# Different pages from which text that all of them have is the template's, and
# the largest part of an article, one in so many characters, that may be constant.
TEMPLATE_PAGES = 8
CONSTANT_PART = 5
# A wrapper describes elements to this depth; the text of deeper ones counts there.
DEPTH = 96
# Neighbours that a wrapper tells apart below one element. Beyond, one group per
# kind is kept, and of more kinds than that the lightest share one entry.
CHILDREN = 128
REST = "rest"


def _weight(w: list, pages: int = 0) -> int:
    """Characters of text in a wrapper that are not skipped; given the number of pages, of slots alone."""
    if w[1] & SKIPPED:
        return 0
    return max(w[2] - pages * sum(w[3].values()), 0) + sum(_weight(c, pages) for c in w[4])


def _own_text(node: Node) -> str:
    return " ".join(" ".join(c for c in node.children if isinstance(c, str)).split())


def _hashed(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=12).hexdigest()


def _text_below(node: Node) -> int:
    n, todo = 0, [node]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            n += len(item.strip())
        elif not item.skipped or item is node:
            todo += item.children
    return n


def _folded(children: list) -> list:
    """Children of bounded number; no text is left out of the weights."""
    if len(children) <= CHILDREN:
        return children
    kinds: dict[str, list] = {}
    for w in children:
        if w[0] in kinds:
            kinds[w[0]] = merge(kinds[w[0]], w, True)
            kinds[w[0]][1] |= REPEATED
        else:
            kinds[w[0]] = w
    if len(kinds) <= CHILDREN:
        return list(kinds.values())
    light = sorted(kinds, key=lambda k: (k != REST, _weight(kinds[k]), k))[: len(kinds) - CHILDREN + 1]
    rest = [REST, OPTIONAL | REPEATED, sum(_weight(kinds[k]) for k in light), {}, []]
    return [*(w for k, w in kinds.items() if k not in set(light)), rest]


def page_wrapper(node: Node, depth: int = DEPTH) -> list:
    """The wrapper of a single page: its tree, with neighbours of one kind merged."""
    if not depth:
        return [node.key, SKIPPED * node.skipped, _text_below(node), {}, []]
    own = _own_text(node)
    children: list = []
    for child in node.children:
        if isinstance(child, str) or child.tag in VOID:
            continue
        w = page_wrapper(child, depth - 1)
        if children and children[-1][0] == w[0]:
            children[-1] = merge(children[-1], w, True)
            children[-1][1] |= REPEATED
        else:
            children.append(w)
    return [node.key, SKIPPED * node.skipped, len(own), {_hashed(own): len(own)} if own else {}, _folded(children)]


def _optional(w: list) -> list:
    """An element that some page lacks: nothing below it is constant."""
    return [w[0], w[1] | OPTIONAL, w[2], {}, [_optional(c) for c in w[4]]]


def merge(a: list, b: list, one_page: bool = False) -> list:
    """Align two wrappers of one element: of different pages, or, as a repeated group, of ``one_page``."""
    constants = {**a[3], **b[3]} if one_page else {h: n for h, n in a[3].items() if h in b[3]}
    left, right, out = a[4], b[4], []
    # Children are aligned by kind: the longest common run of kinds is kept.
    la, lb = [c[0] for c in left], [c[0] for c in right]
    table = [[0] * (len(lb) + 1) for _ in range(len(la) + 1)]
    for i in range(len(la) - 1, -1, -1):
        for j in range(len(lb) - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if la[i] == lb[j] else max(table[i + 1][j], table[i][j + 1])
    i = j = 0
    while i < len(la) or j < len(lb):
        if i < len(la) and j < len(lb) and la[i] == lb[j]:
            one = merge(left[i], right[j], one_page)
            i, j = i + 1, j + 1
        elif j == len(lb) or (i < len(la) and table[i + 1][j] >= table[i][j + 1]):
            one, i = left[i] if one_page else _optional(left[i]), i + 1
            one = [one[0], one[1] | OPTIONAL, *one[2:]]
        else:
            one, j = right[j] if one_page else _optional(right[j]), j + 1
            one = [one[0], one[1] | OPTIONAL, *one[2:]]
        if out and out[-1][0] == one[0]:
            one = merge(out[-1], one, True)
            one[1] |= REPEATED
            out[-1] = one
        else:
            out.append(one)
    return [a[0], a[1] | b[1], a[2] + b[2], constants, _folded(out)]


def content_path(wrapper: list, pages: int = 0) -> list[str]:
    """Keys from the root to the element that holds the article.

    The main element of that name if there is one, else the deepest one that
    holds most of the text that is not skipped; slots alone count if the
    number of pages is given and there are any.
    """
    if not _weight(wrapper, pages):
        pages = 0
    weight = lambda w: _weight(w, pages)

    def named(w: list, path: list[str]) -> list[tuple[int, list[str]]]:
        if w[1] & SKIPPED:
            return []
        here = [*path, w[0]]
        mine = [(weight(w), here)] if w[0].split(".")[0] in CONTENT else []
        return mine + [x for c in w[4] for x in named(c, here)]

    found = named(wrapper, [])
    if found and max(found)[0] > 0:
        return max(found, key=lambda x: x[0])[1]
    path, node, whole = [wrapper[0]], wrapper, weight(wrapper)
    while True:
        best = max(node[4], key=weight, default=None)
        if best is None or weight(best) * 10 < whole * 8 or best[0].split(".")[0] not in BLOCKS or not best[4]:
            return path
        if best[0].split(".")[0] in ("p", "ul", "ol", "table", "li") or best[1] & REPEATED:
            return path
        path, node = [*path, best[0]], best


def template_texts(wrapper: list, path: list[str], pages: int) -> dict[str, list[str]]:
    """Per place (keys from the root, one a line) the hashes of the constant texts below a path.

    None where they are too large a part of the article to be the template's.
    """
    level = [wrapper]
    for key in path[1:]:
        level = [c for w in level for c in w[4] if c[0] == key and not c[1] & SKIPPED]
    found: dict[str, list[str]] = {}
    todo, constant = [("\n".join(path), w) for w in level], 0
    while todo:
        place, w = todo.pop()
        if w[3]:
            found.setdefault(place, []).extend(w[3])
            constant += sum(w[3].values())
        todo += [(f"{place}\n{c[0]}", c) for c in w[4] if not c[1] & SKIPPED]
    return found if constant * pages * CONSTANT_PART <= sum(map(_weight, level)) else {}


def _drop_template(root: Node, constants: dict[str, list[str]]) -> None:
    """Take the constant texts out of a page."""
    todo = [(root.key, root)]
    while todo:
        place, node = todo.pop()
        if place in constants and _hashed(_own_text(node)) in constants[place]:
            node.children = [c for c in node.children if isinstance(c, Node)]
        # Places are only as deep as the wrapper, and only those on the way matter.
        if place.count("\n") <= DEPTH:
            todo += [(f"{place}\n{c.key}", c) for c in node.children if isinstance(c, Node)]


def _below(node: Node, path: list[str]) -> list[Node]:
    """The elements at a path from the root."""
    level = [node]
    for key in path[1:]:
        level = [c for n in level for c in n.children if isinstance(c, Node) and c.key == key and not c.skipped]
    return level


def _named_content(node: Node) -> list[Node]:
    """A page's own articles, or main elements, outermost first."""
    for kind in ("article", "main"):
        found, todo = [], [node]
        while todo:
            item = todo.pop()
            if item.skipped:
                continue
            if item.tag == kind:
                found.append(item)
            else:
                todo += [c for c in reversed(item.children) if isinstance(c, Node)]
        if found:
            return found
    return []


def main_text(html: str, path: list[str] | None, constants: dict[str, list[str]] | None = None) -> str:
    """The article of a page, below the wrapper's content element and without its constants."""
    root = parse(html)
    if constants:
        _drop_template(root, constants)
    named = _named_content(root)
    tops = (_below(root, path) if path else []) or named or [root]
    if named and not any(t in named for t in tops):
        tops = named
    return "\n".join(b for t in tops for b in blocks(t))


def joined(a: dict, b: dict) -> dict:
    """The wrapper of two sets of a host's pages. ``seen`` are up to ``TEMPLATE_PAGES`` hashes of different pages."""
    seen = sorted({*a["seen"], *b["seen"]})[:TEMPLATE_PAGES]
    return {"pages": a["pages"] + b["pages"], "seen": seen, "wrapper": merge(a["wrapper"], b["wrapper"])}


def host_rule(host: dict) -> dict:
    """Where a host's article stands and which texts below are its template's."""
    pages = host["pages"] if len(host["seen"]) >= TEMPLATE_PAGES else 0
    path = content_path(host["wrapper"], pages)
    return {"path": path, "constants": template_texts(host["wrapper"], path, pages) if pages else {}}


def wrappers(pages: DataFrame) -> DataFrame:
    """``host`` and ``wrapper`` (JSON): every page takes part."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known_hosts: dict[str, dict] = {}
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                page = html.as_py()
                w = {"pages": 1, "seen": [_hashed(page)], "wrapper": page_wrapper(parse(page))}
                known_hosts[host] = joined(known_hosts[host], w) if host in known_hosts else w
            yield pa.RecordBatch.from_pydict(
                {"host": list(known_hosts), "wrapper": [json.dumps(w) for w in known_hosts.values()]},
                pa.schema([("host", pa.string()), ("wrapper", pa.string())]),
            )

    def merged(group: pa.Table) -> pa.Table:
        whole: dict | None = None
        for text in group.column("wrapper").to_pylist():
            w = json.loads(text)
            whole = w if whole is None else joined(whole, w)
        return pa.table({"host": group.column("host").slice(0, 1), "wrapper": [json.dumps(whole)]})

    schema = "host string, wrapper string"
    parts = pages.select("host", "html").mapInArrow(partial, schema)
    # Two steps: at most the square root of a hot host's partial wrappers meet in one task each.
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(64)))
    return salted.groupBy("host", "salt").applyInArrow(merged, schema).groupBy("host").applyInArrow(merged, schema)


def main_texts(pages: DataFrame) -> DataFrame:
    """Every page's main text."""
    host = F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))
    rows = pages.select("page_id", "url", host.alias("host"), known("html").alias("html"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rules = [json.dumps(host_rule(json.loads(w))) for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rules, pa.string())], ["rule_host", "rule"])

    rules = wrappers(rows).mapInArrow(found, "rule_host string, rule string")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rules = {r: json.loads(r) for r in batch.column(3).unique().to_pylist() if r}
            none = {"path": None, "constants": None}
            texts = [
                main_text(html.as_py(), **rules.get(rule, none)) for html, rule in zip(batch.column(2), batch.column(3).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    ruled = rows.join(rules, rows["host"] == rules["rule_host"], "left").select("page_id", "url", "html", "rule")
    texts = ruled.mapInArrow(read, "page_id bigint, url string, text string")
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
