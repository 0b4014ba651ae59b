"""Main text of web pages by templates inferred per host.

The template of a host is a union-free expression over the tags and texts of its
pages: elements in order, some optional, some repeated, with text slots. It is
inferred by alignment. Where the streams of two pages differ, neighbours that
repeat become a repeated group, an element that only one side has becomes
optional, and a text that differs becomes a slot.

1. Names (class, id, role, item property) that at least half of a host's pages
   bear are counted; slugs and categories do not tell elements apart.
2. Each task gathers its pages by structure. Pages of one structure differ in
   texts only; every text keeps a majority vote. The structures are then aligned
   pair by pair in a balanced tree, in the task and across tasks. An element that
   less than one in KEEP of the pages bear is dropped from the wrapper, so it never holds more
   than KEEP times an average page, and one odd page changes nothing.
3. Texts that the wrapper gives outside of repeated groups are counted exactly,
   over pages that differ in what they say: such a text is the template's if at least
   SHARE percent of the pages with an element at its place say it, half
   of the host's pages do, and CONSTANT pages do.

A page then gives its main text by this rule: texts inside menus, headers,
footers, sidebars, notices, adverts, forms and comments are not, the template's
own texts are not, and where a page marks its article, only texts inside it are,
all of them. Where nothing is marked, all that is left is main text.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findrift.llm.store import batched, written

ITEMS = 300_000  # names, or elements and texts, held by a map task before they are sent on
FAN = 64  # groups of a host's rows in the second step
SHOWN = 40  # characters of a text that a wrapper shows; its digest stands for the whole
CONSTANT = 3  # pages of different text that must agree before a text counts as template
SHARE = 90  # percent of the pages with an element at its place that say a text of the template
KEEP = 8  # an element on fewer than one in KEEP pages leaves the wrapper
LEVELS = 100  # depth of a wrapper; texts in deeper elements are never template

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output "
    "q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SAME = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th",
        "option": "option", "optgroup": "option optgroup", "thead": "", "tbody": "thead tbody tr td th",
        "tfoot": "thead tbody tr td th"}
SCOPE = frozenset("table ul ol dl select body html td th div article section main".split())

# Elements and names that are not main text.
OUTSIDE = frozenset(
    "head script style noscript template nav header footer aside form button select option textarea input "
    "iframe object svg canvas dialog menu noembed noframes audio video map datalist".split()
)
NAMES = re.compile(
    r"(?:^|[-_\s])(?:nav|navbar|navigation|menu|submenu|header|masthead|footer|foot|sidebar|side|aside|"
    r"ad|ads|adv|advert|adverts|advertisement|banner|promo|sponsor|sponsored|cookie|cookies|consent|gdpr|"
    r"notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|comment|comments|respond|reply|"
    r"replies|discussion|disqus|share|sharing|social|related|recommended|breadcrumb|breadcrumbs|pagination|"
    r"pager|toolbar|widget|search|copyright|skip|hidden|contentinfo|complementary)(?:$|[-_\s\d])"
)
MAIN = re.compile(
    r"(?:^|[-_\s])(?:article|articlebody|post|entry|story|main|content|maincontent|body)(?:$|[-_\s])"
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<",
    re.DOTALL,
)
_ATTR = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


class Node:
    """An element of a page or wrapper; `kids` are nodes and texts in order, `seen` the pages that have it.

    The root of a wrapper holds digests of up to CONSTANT different page texts (`prints`).
    """

    __slots__ = ("tag", "name", "kids", "many", "maybe", "seen", "prints")

    def __init__(self, tag: str, name: str = "", kids=None, many=False, maybe=False, seen=1, prints=frozenset()):
        self.tag, self.name, self.kids = tag, name, [] if kids is None else kids
        self.many, self.maybe = many, maybe
        self.seen, self.prints = seen, prints

    @property
    def key(self) -> tuple[str, str]:
        return self.tag, self.name


class Text:
    """A text of a page or wrapper: what most of its `seen` pages say, by digest and beginning, and its `votes`.

    Votes are those for the text less those against it. A text that more than half of the pages say is
    never voted out, in whatever order they are met; with fewer votes than pages, the place is a slot.
    """

    __slots__ = ("shown", "seen", "votes", "maybe", "digest")

    key = ("#", "")

    def __init__(self, shown: str, digest: str, seen: int = 1, votes: int = 1, maybe: bool = False):
        self.shown, self.digest, self.seen, self.votes, self.maybe = shown, digest, seen, votes, maybe

    @property
    def string(self) -> str | None:
        """Beginning of the text all pages share; None for a slot."""
        return self.shown if self.votes == self.seen else None

    def vote(self, other: Text) -> None:
        """Take in what other pages say in this place."""
        self.seen += other.seen
        self.maybe |= other.maybe
        if self.digest == other.digest:
            self.votes += other.votes
        elif self.votes >= other.votes:
            self.votes -= other.votes
        else:
            self.shown, self.digest, self.votes = other.shown, other.digest, other.votes - self.votes


def digest(s: str) -> str:
    """Length and 128 bits of a whole text."""
    return f"{len(s)}:{blake2b(s.encode('utf-8', 'replace'), digest_size=16).hexdigest()}"


def _name(attrs: str) -> str:
    """What tells elements of a tag apart: class, id, role and item property, numbers left out."""
    found = {}
    for m in _ATTR.finditer(attrs):
        key = m.group(1).lower()
        value = next((g for g in m.groups()[1:] if g is not None), "").lower()
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                found["hidden"] = "hidden"
        elif key == "aria-hidden":
            if value == "true":
                found["hidden"] = "hidden"
        elif key == "hidden":
            found["hidden"] = "hidden"
        else:
            found.setdefault(key, " ".join(re.sub(r"\d+", "", value).split()))
    return " ".join(found[k] for k in ("class", "id", "role", "itemprop", "hidden") if found.get(k))


class Open:
    """The open elements of a page, to any depth; a tag is found in them without a search."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # places of elements that are not inline
        self.scopes: list[int] = []

    def push(self, node: Node) -> None:
        at = len(self.nodes)
        self.nodes.append(node)
        self.places.setdefault(node.tag, []).append(at)
        if node.tag not in INLINE:
            self.blocks.append(at)
        if node.tag in SCOPE:
            self.scopes.append(at)

    def cut(self, at: int) -> None:
        """End the element at a place and all it holds."""
        while len(self.nodes) > at:
            tag = self.nodes.pop().tag
            self.places[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()
            if tag in SCOPE:
                self.scopes.pop()

    def end(self, tag: str) -> None:
        """An end tag ends the nearest element of its tag; an inline one reaches no further than its block."""
        if places := self.places.get(tag):
            if tag not in INLINE or not self.blocks or places[-1] > self.blocks[-1]:
                self.cut(places[-1])

    def close(self, tags: str) -> None:
        """End the nearest open element of `tags`, if no scope lies between."""
        at = max((self.places[t][-1] for t in tags.split() if self.places.get(t)), default=0)
        if at and (not self.scopes or at >= self.scopes[-1]):
            self.cut(at)


def parse(html: str) -> Node:
    """The element tree of a page, with missing end tags supplied."""
    root = Node("#root")
    opened = Open(root)
    nodes = opened.nodes
    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.match(html, at)
        if m is None:  # a tag that never ends
            break
        at = m.end()
        tag = m.group(2)
        if tag is None:
            s = m.group()
            if s.startswith("<![CDATA["):
                nodes[-1].kids.append(s[9:-3])
            elif not s.startswith(("<!", "<?")):
                nodes[-1].kids.append(entities.unescape(s))
            continue
        tag = tag.lower()
        if m.group(1):
            opened.end(tag)
            continue
        if tag in CLOSES_P:
            opened.close("p")
        if tag in SAME:
            opened.close(SAME[tag])
        node = Node(tag, _name(m.group(3)) if m.group(3) else "")
        nodes[-1].kids.append(node)
        if tag in RAW:
            stop = _RAW_END[tag].search(html, at)
            at = stop.end() if stop else end
        elif tag not in VOID and not m.group(3).endswith("/"):
            opened.push(node)
    return root


def shape(tree: Node, names: frozenset[str] | None = None) -> Node:
    """A page as a wrapper of itself: inline markup becomes text, repeats become groups, outside elements are empty."""
    root = _shape(tree, names, LEVELS)
    root.prints = frozenset([fingerprint(blocks(tree))])
    return root


def _shape(node: Node, names: frozenset[str] | None, levels: int) -> Node:
    out: list = []
    part: list[str] = []

    def flush():
        s = " ".join("".join(part).split())
        part.clear()
        if s:
            out.append(Text(s[:SHOWN], digest(s)))

    for k in _flat(node):
        if isinstance(k, str):
            part.append(k)
        else:
            flush()
            if levels:
                out.append(_shape(k, names, levels - 1))
    flush()
    return Node(node.tag, shared_name(node, names), fold(out))


def shared_name(node: Node, names: frozenset[str] | None) -> str:
    """The name of an element, less what its host's pages do not share."""
    if not node.name or names is None:
        return node.name
    return " ".join(x for x in node.name.split() if f"{node.tag} {x}" in names)


def _flat(node: Node) -> Iterator:
    """Texts and elements of a node, inline elements opened up, outside elements emptied."""
    stack = [iter(node.kids)]
    while stack:
        for k in stack[-1]:
            if isinstance(k, str):
                yield k
            elif outside(k.tag, k.name):
                if k.tag not in INLINE:
                    yield Node(k.tag, k.name)
            elif k.tag in INLINE:
                if k.tag == "br":
                    yield " "
                stack.append(iter(k.kids))
                break
            else:
                yield k
        else:
            stack.pop()


def fold(kids: list) -> list:
    """Neighbouring equal runs of one to three items become one repeated run."""
    for width in (1, 2, 3):
        at = 0
        while at + 2 * width <= len(kids):
            a, b = kids[at : at + width], kids[at + width : at + 2 * width]
            if all(x.key == y.key for x, y in zip(a, b, strict=True)) and any(isinstance(x, Node) for x in a):
                run = [align(x, y, same=True) for x, y in zip(a, b, strict=True)]
                for x in run:
                    if isinstance(x, Node):
                        x.many = True
                kids[at : at + 2 * width] = run
            else:
                at += 1
    return kids


def align(a, b, floor: float = 0, same: bool = False):
    """The wrapper of both: two texts, or two elements of one key. `same` says that both are of the same pages.
    What fewer than `floor` pages have is left out."""
    seen = max(a.seen, b.seen) if same else a.seen + b.seen
    if isinstance(a, Text):
        a.vote(b)
        a.seen, a.votes = seen, min(a.votes, seen)
        return a
    prints = frozenset(sorted(a.prints | b.prints)[:CONSTANT])
    return Node(a.tag, a.name, _align(a.kids, b.kids, floor, same), a.many or b.many, a.maybe or b.maybe, seen, prints)


def common_places(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, by rows of bits: as many machine words as the lists need."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row, rows = full, []
    for y in b:
        on = row & where.get(y, 0)
        row = ((row + on) | (row - on)) & full
        rows.append(row)
    i, j, out = len(a), len(b), []
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
            continue
        j -= 1
        if j and not rows[j - 1] >> (i - 1) & 1:
            continue
        i -= 1
        out.append((i, j))
    return out[::-1]


def _align(a: list, b: list, floor: float, same: bool) -> list:
    """Align two lists of items by their longest common subsequence of keys; the rest is optional."""
    ka, kb = [x.key for x in a], [y.key for y in b]
    both = [(i, i) for i in range(len(a))] if ka == kb else common_places(ka, kb)
    out, i, j = [], 0, 0
    for x, y in [*both, (len(a), len(b))]:
        for k in (*a[i:x], *b[j:y]):
            k.maybe = True
            out.append(k)
        if x < len(a):
            out.append(align(a[x], b[y], floor, same))
        i, j = x + 1, y + 1
    return fold([k for k in out if k.seen >= floor])


def merged(wrappers: list[Node]) -> Node:
    """The wrapper of wrappers of different pages, aligned in a balanced tree."""
    while len(wrappers) > 1:
        wrappers = sorted(wrappers, key=lambda x: x.seen)
        pairs = zip(wrappers[::2], wrappers[1::2], strict=False)
        odd = wrappers[-1:] if len(wrappers) % 2 else []
        wrappers = [align(a, b, (a.seen + b.seen) / KEEP) for a, b in pairs] + odd
    return wrappers[0]


def outline(node: Node, texts: list[Text], out: list[str]) -> None:
    """The structure of a wrapper as a list of marks, and its texts in order."""
    for k in node.kids:
        if isinstance(k, Text):
            texts.append(k)
            out.append("?#" if k.maybe else "#")
        else:
            out.append(f"<{k.tag} {k.name}{'*' * k.many}{'?' * k.maybe}")
            outline(k, texts, out)
            out.append(">")


def counted(node: Node, pages: int) -> None:
    """Set the pages of a wrapper that was met on so many pages of one structure."""
    node.seen = pages
    for k in node.kids:
        if isinstance(k, Node):
            counted(k, pages)


def dump(x) -> list:
    if isinstance(x, Text):
        return [x.shown, x.digest, x.seen, x.votes, int(x.maybe)]
    out = [x.tag, x.name, x.seen, [dump(k) for k in x.kids], int(x.many) | int(x.maybe) << 1]
    return [*out, sorted(x.prints)] if x.prints else out


def load(x: list):
    if isinstance(x[3], list):
        return Node(x[0], x[1], [load(k) for k in x[3]], bool(x[4] & 1), bool(x[4] & 2), x[2], *map(frozenset, x[5:]))
    return Text(x[0], x[1], x[2], x[3], bool(x[4]))


@lru_cache(maxsize=1 << 16)
def outside(tag: str, name: str) -> bool:
    """An element that holds no main text, by its tag or its name."""
    return tag in OUTSIDE or bool(name and NAMES.search(name))


@lru_cache(maxsize=1 << 16)
def mark(tag: str, name: str) -> int:
    """How an element marks main text: 4 as article, 2 as main, 1 by its name, 0 not at all."""
    if tag in ("article", "main"):
        return 4 if tag == "article" else 2
    return int(tag in ("div", "section", "td") and bool(name and MAIN.search(name)) and not NAMES.search(name))


@lru_cache(maxsize=1 << 16)
def step(path: str, tag: str, name: str) -> str:
    """The path of an element under `path`, as a digest of the keys on the way."""
    return blake2b(f"{path}<{tag} {name}".encode("utf-8", "replace"), digest_size=16).hexdigest()


def blocks(
    tree: Node, names: frozenset[str] | None = None, many: set[str] | None = None
) -> list[tuple[str, int, str]]:
    """(path, marks, text) of the blocks of a page that no outside element holds; marks of all elements around.

    Paths bear the `names` only, if given. `many` receives the paths of repeated elements and all below them.
    """
    out: list[tuple[str, int, str]] = []
    part: list[str] = []
    above: dict[str, str] = {}
    twice: set[str] = set()

    def flush(path: str, marks: int) -> None:
        s = " ".join("".join(part).split())
        part.clear()
        if s:
            out.append((path, marks, s))

    stack = [(iter(tree.kids), "", 0, False)]
    while stack:
        kids, path, marks, inline = stack[-1]
        for k in kids:
            if isinstance(k, str):
                part.append(k)
            elif outside(k.tag, k.name):
                if k.tag not in INLINE:
                    flush(path, marks)
            elif k.tag in INLINE:
                if k.tag == "br":
                    part.append(" ")
                stack.append((iter(k.kids), path, marks, True))
                break
            else:
                flush(path, marks)
                down = step(path, k.tag, shared_name(k, names))
                if many is not None:
                    if down in above:
                        twice.add(down)
                    above[down] = path
                stack.append((iter(k.kids), down, marks | mark(k.tag, k.name), False))
                break
        else:
            stack.pop()
            if not inline:
                flush(path, marks)
    if many is not None:
        for down, path in above.items():  # elements before those they hold
            if down in twice or path in many:
                many.add(down)
    return out


def _named(tree: Node) -> set[str]:
    """The names of a page's elements, each with its tag, outside elements and inline ones left out."""
    out: set[str] = set()
    stack = [tree]
    while stack:
        for k in stack.pop().kids:
            if isinstance(k, Node) and not outside(k.tag, k.name):
                if k.name and k.tag not in INLINE:
                    out.update(f"{k.tag} {x}" for x in k.name.split())
                stack.append(k)
    return out


def fingerprint(found: list[tuple[str, int, str]]) -> str:
    """Digest of all that a page says outside of outside elements: copies with other adverts are one."""
    return digest("\n".join(s for _, _, s in found))


def candidates(wrapper: Node) -> list[tuple[str, Text]]:
    """Path and text of what may be the template's: texts outside of repeated groups, on a good part of the pages."""
    out: list[tuple[str, Text]] = []

    def walk(node: Node, path: str) -> None:
        for k in node.kids:
            if KEEP * k.seen < 2 * wrapper.seen:
                continue
            if isinstance(k, Text):
                if k.votes:
                    out.append((path, k))
            elif not k.many:
                walk(k, step(path, *k.key))

    walk(wrapper, "")
    return out


def constants(wrapper: Node) -> set[str]:
    """Path and digest of the texts that, by their votes, are the template's; none where fewer than CONSTANT
    pages differ in what they say."""
    if len(wrapper.prints) < CONSTANT:
        return set()
    return {
        f"{path} {k.digest}"
        for path, k in candidates(wrapper)
        if 100 * k.votes >= SHARE * k.seen and 2 * k.votes >= wrapper.seen
    }


class Rules:
    """What a template says about the pages of its host: the names that make paths (None: all), and its texts."""

    def __init__(self, wrapper: Node | None):
        self.names: frozenset[str] | None = None
        self.constants = constants(wrapper) if wrapper else set()

    def dump(self) -> str:
        return json.dumps({"names": self.names and sorted(self.names), "common": sorted(self.constants)})

    @classmethod
    def load(cls, text: str | None) -> Rules:
        rules = cls(None)
        if text:
            said = json.loads(text)
            rules.names = None if said["names"] is None else frozenset(said["names"])
            rules.constants = set(said["common"])
        return rules

    def text(self, html: str | None) -> str:
        """Main text of a page: a line per block.

        The page's articles, else its main elements, else those marked by name. Where
        these hold template texts only, they do not end the search; a page without a
        marked element that says something of its own gives all it has, less the
        template's texts outside marked elements.
        """
        if not html:
            return ""
        found = blocks(parse(html), self.names)
        own = [not self.constants or f"{path} {digest(s)}" not in self.constants for path, _, s in found]
        take = 0
        for bit in (4, 2, 1):
            inside = [o for o, (_, marks, _) in zip(own, found, strict=True) if marks & bit]
            take |= bit if inside else 0
            if any(inside):
                return "\n".join(s for _, marks, s in found if marks & take)
        return "\n".join(s for o, (_, marks, s) in zip(own, found, strict=True) if marks or o)


def host(col: Column) -> Column:
    """The host of an address, in lower case; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(col, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[1]:
                yield row


NAMED = "host string, name string, n bigint"


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, name, pages): the pages of a task that bear a name; their number under the name null."""
    held: Counter = Counter()

    def out():
        rows = list(held.items())
        for lo in range(0, len(rows), 1 << 16):
            cut = rows[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([h for (h, _), _ in cut], pa.string()),
                    pa.array([x for (_, x), _ in cut], pa.string()),
                    pa.array([n for _, n in cut], pa.int64()),
                ],
                names=["host", "name", "n"],
            )
        held.clear()

    for name, page in _pages(batches):
        held.update((name, x) for x in _named(parse(page)))
        held[name, None] += 1
        if len(held) >= ITEMS:
            yield from out()
    yield from out()


WRAPPED = pa.schema([("host", pa.string()), ("part", pa.int64()), ("wrapper", pa.string())])
WRAPPED_DDL = "host string, part bigint, wrapper string"


def number(s: str) -> int:
    """64 bits of a digest."""
    return int.from_bytes(blake2b(s.encode(), digest_size=8).digest(), "little", signed=True)


def _wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A wrapper of each host's pages in a task: gathered by structure, structures aligned. Copies count once."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held: dict[str, dict[str, tuple[Node, list[Text]]]] = {}
    copies: set[tuple[str, int]] = set()
    shared: dict[str, frozenset[str]] = {}
    items = 0

    def out():
        for name, groups in held.items():
            for tree, texts in groups.values():
                counted(tree, tree.seen)
            said = json.dumps(dump(merged([tree for tree, _ in groups.values()])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([name], pa.string()), pa.array([part], pa.int64()), pa.array([said], pa.string())], schema=WRAPPED
            )

    for name, page, names in _pages(batches):
        if name not in shared:
            shared[name] = frozenset(names)
        tree = shape(parse(page), shared[name])
        said = (name, number(next(iter(tree.prints))))
        if said in copies:
            continue
        copies.add(said)
        texts: list[Text] = []
        marks: list[str] = []
        outline(tree, texts, marks)
        groups = held.setdefault(name, {})
        known = groups.setdefault(digest("".join(marks)), (tree, texts))
        if known[0] is tree:
            items += len(marks)
        else:
            for x, y in zip(known[1], texts, strict=True):
                x.vote(y)
            known[0].seen += 1
            known[0].prints = frozenset(sorted(known[0].prints | tree.prints)[:CONSTANT])
        items += 1
        if items >= ITEMS:
            yield from out()
            held, copies, shared, items = {}, set(), {}, 0
    yield from out()


def _joined(rows: pd.DataFrame) -> pd.DataFrame:
    """The wrapper of the wrappers of a group."""
    tree = merged([load(json.loads(x)) for x in rows.sort_values(["part", "wrapper"])["wrapper"]])
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "part": [int(rows["part"].min())], "wrapper": [json.dumps(dump(tree))]})


def _tree(parts: DataFrame) -> DataFrame:
    """One row per host of rows by host and task."""
    fans = parts.withColumn("fan", F.pmod(F.col("part"), F.lit(FAN)))
    first = fans.groupBy("host", "fan").applyInPandas(lambda x: _joined(x.drop(columns="fan")), WRAPPED_DDL)
    return first.groupBy("host").applyInPandas(_joined, WRAPPED_DDL)


def _said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, text) of the texts of the host's wrapper that may be the template's, as path and digest."""
    for batch in batches:
        for name, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            texts = sorted({f"{path} {k.digest}" for path, k in candidates(load(json.loads(said)))})
            yield pa.RecordBatch.from_arrays(
                [pa.array([name], pa.string()), pa.array([texts], pa.list_(pa.string()))], names=["host", "texts"]
            )


HELD = "host string, at int, print bigint, hit boolean"


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, number of the text, page print, whether said) where a page has an element at a text's place; -1 for the page."""
    last, places = None, {}
    for batch in batches:
        rows = []
        for name, page, names, texts in _pages(iter([batch])):
            if name != last:
                last, names_of, places = name, frozenset(names), {}
                for at, x in enumerate(texts):
                    path, whole = x.split(" ", 1)
                    places.setdefault(path, []).append((at, whole))
            many: set[str] = set()
            found = blocks(parse(page), names_of, many)
            said = number(fingerprint(found))
            rows.append((name, -1, said, True))
            here: dict[str, set[str]] = {}
            for path, _, s in found:
                if path in places:
                    here.setdefault(path, set()).add("" if path in many else digest(s))
            rows.extend((name, at, said, whole in own) for path, own in here.items() for at, whole in places[path])
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.bool_()), strict=True)],
            names=["host", "at", "print", "hit"],
        )


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, rules): the template of every host from all its pages, null where no text is the template's.
    Pages without html say nothing."""
    batched(pages.sparkSession)
    rows = pages.select(host(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").cast("string").alias("html"))
    bearing = written(rows.mapInArrow(_names, NAMED).groupBy("host", "name").agg(F.sum("n").alias("n")), "names")
    hosts = bearing.where("name IS NULL").select("host", F.col("n").alias("pages"))
    usual = bearing.join(hosts, "host").where("name IS NOT NULL AND 2 * n >= pages").groupBy("host").agg(
        F.sort_array(F.collect_list("name")).alias("names")  # at most twice the names of an average page
    )
    none = F.array().cast("array<string>")
    several = written(
        hosts.where(F.col("pages") >= CONSTANT).join(usual, "host", "left")
        .select("host", F.coalesce("names", none).alias("names")),
        "hosts",
    )
    wrappers = _tree(rows.join(several, "host").select("host", "html", "names").mapInArrow(_wrapped, WRAPPED_DDL))
    maybe = written(
        wrappers.select("host", "wrapper").mapInArrow(_said, "host string, texts array<string>")
        .where(F.size("texts") > 0).join(several, "host").select("host", "names", "texts"),
        "candidates",
    )
    met = rows.join(maybe, "host").select("host", "html", "names", "texts").mapInArrow(_held, HELD)
    # pages that say the same are one page
    each = met.groupBy("host", "at", "print").agg(F.max("hit").alias("hit"))
    tally = written(each.groupBy("host", "at").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits")), "tally")
    of = tally.where("at < 0").select("host", F.col("n").alias("pages"))
    sure = (F.col("hits") >= CONSTANT) & (100 * F.col("hits") >= SHARE * F.col("n")) & (2 * F.col("hits") >= F.col("pages"))
    texts = tally.where("at >= 0").join(of, "host").where(sure).groupBy("host").agg(F.sort_array(F.collect_list("at")).alias("ats"))
    said = maybe.join(texts, "host").select(
        "host", F.to_json(F.struct("names", F.transform("ats", lambda i: F.get("texts", i)).alias("common"))).alias("rules")
    )
    return hosts.join(said, "host", "left").select("host", "rules")


@lru_cache(maxsize=4096)
def _rules(text: str | None) -> Rules:
    return Rules.load(text)


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(id_col, url_col, text, n_chars) of every row: the main text by its host's wrapper.

    Null or empty html has an empty text. Pages without an address share one
    wrapper. Repeated rows are pages like others; a null id stays null. Other
    columns are not read. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    batched(spark)
    kind = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    rules = written(infer(pages, url_col, html_col).where("rules IS NOT NULL"), "wrappers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                _rules(r).text(h)
                for h, r in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["_id", "_url", "text", "n_chars"],
            )

    rows = pages.select(
        F.col(f"`{id_col}`").alias("_id"),
        F.col(f"`{url_col}`").alias("_url"),
        F.col(f"`{html_col}`").cast("string").alias("_html"),
        host(F.col(f"`{url_col}`")).alias("host"),
    )
    return (
        rows.join(rules, "host", "left")
        .select("_id", "_url", "_html", "rules")
        .mapInArrow(run, f"_id {kind[id_col]}, _url {kind[url_col]}, text string, n_chars bigint")
        .withColumnsRenamed({"_id": id_col, "_url": url_col})
    )
