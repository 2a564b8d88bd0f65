"""Main text of web pages by equivalence-class template deduction (operator 3).

Pages of one host are dealt to groups of some ``GROUP_PAGES`` by a hash of their id, so a host of any size is many
tasks and every page is in one group. In a group each page becomes a sequence of tokens: tags with their
path and class, and whole text nodes with their path.

1. *Classes.* Tokens with the same occurrence vector (counts by page) in at least half of the pages form an equivalence class; a class
   is valid if its tokens stand in one order in every page. The largest valid class that occurs once a page is the root.
2. *Roles.* A token that stands in several slots of the root, or at fixed places within one, plays a role of its own in each. With
   roles for tokens, classes are found anew until the root grows no more. Other valid classes nest in its slots.
3. *Region.* Paired tags of the root are the elements of the template. From the page down, the main text lies in the child element that holds
   ``SHARE`` of the text of its parent, as long as there is one; a varying heading before it belongs to it. Only text
   counts that no class holds; links and the insides of furniture marks count nothing, of main marks twice.
4. *Slots* of the region are kept, whatever they hold. Left out are furniture elements in them, and elements that hold only words of root
   or nested classes on pages that otherwise differ. If the region also holds text beside a main mark, the mark decides.

Text inside the region is never dropped for being frequent alone: copies of an article keep their text.

Cases: null or empty html gives an empty text; a host with one page, or pages that share nothing, is judged
by marks alone; pages without the root's tokens (plain text, fragments, a second layout) are a group of their own, judged in
the same way; a page with nothing in the region keeps the slots with text of its own; unclosed, misnested and cut-off markup is
repaired as it comes, in time linear in the page, however deep; very long pages are read whole; a page without markup is
text; repeated rows are pages of their own; a null url is a host of its own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from hashlib import blake2b
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfolk.functions.scratch import materialize
from kinfolk.llm.common import table

GROUP_PAGES = 48
#: Hosts of several groups that are broadcast, some 100 bytes each; beyond, a salted join takes their place.
BROADCAST_HOSTS = 200_000
SALTS = 64
#: Part of its parent's text that an element must hold to be the way down to the main text.
SHARE = 2 / 3
ROUNDS = 6

# HTML elements by kind, and names that mark page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
FURNITURE_TAGS = frozenset(
    "nav header footer aside form script style noscript head title button select option textarea iframe svg menu template dialog".split()
)
FURNITURE_NAMES = frozenset(
    "ad ads advert advertisement adverts banner sponsor sponsored promo cookie cookies consent notice notices nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer sidebar aside comment comments reply replies share social related newsletter subscribe popup modal login search widget toolbar legal copyright".split()
)
#: Last parts of names such as comment-list, whose first part tells what they are.
HOLDERS = frozenset("area bar block box button buttons container form item items link links list panel section text thread widget wrap wrapper".split())
MAIN_TAGS = frozenset(("article", "main"))
MAIN_NAMES = frozenset(("article", "main", "content", "post", "entry", "story"))
WAYS = frozenset("html body div section article main center table tbody tr td form".split())
HEADINGS = frozenset(("h1", "h2", "h3"))
CONTAINERS = frozenset("div section ul ol dl table blockquote figure fieldset details address center".split())
CLOSES_P = BLOCKS - {"br", "option", "optgroup"}
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PART = re.compile(r"[-_]+")


class Element:
    """An open element: what it is, what it is in, and what that makes of text in it."""

    __slots__ = ("tag", "names", "parent", "path", "key", "furniture", "main", "link", "at")

    def __init__(self, tag: str, names: frozenset, parent: Element | None, path: int, key: int, at: int):
        self.tag, self.names, self.parent, self.path, self.key, self.at = tag, names, parent, path, key, at
        known = tag not in ("html", "body")
        own = tag in FURNITURE_TAGS or (known and (tag in CONTAINERS or tag in MAIN_TAGS) and any(map(is_furniture_name, names)))
        self.furniture = own or (parent is not None and parent.furniture)
        self.main = tag in MAIN_TAGS or (known and bool(names & MAIN_NAMES)) or (parent is not None and parent.main)
        self.link = tag == "a" or (parent is not None and parent.link)


@dataclass
class Node:
    """A text between two marks: the element it is in and whether a block begins before it."""

    text: str
    element: Element | None
    block: bool
    at: int  # number of tokens before it

    @property
    def furniture(self) -> bool:
        return self.element is not None and self.element.furniture

    @property
    def main(self) -> bool:
        return self.element is not None and self.element.main


@dataclass
class Page:
    tokens: list[int] = field(default_factory=list)
    nodes: list[Node] = field(default_factory=list)


class Words(dict):
    """Numbers of tokens and paths, in order of their first use; one for all pages of a group."""

    def __missing__(self, key: tuple) -> int:
        n = self[key] = len(self)
        return n


def is_furniture_name(name: str) -> bool:
    """A name of the list, or one that ends in such a part (site-header), or begins with one and ends in a holder (comment-list)."""
    parts = _PART.split(name)
    return name in FURNITURE_NAMES or parts[-1] in FURNITURE_NAMES or (parts[0] in FURNITURE_NAMES and parts[-1] in HOLDERS)


def _digest(words: str) -> bytes | str:
    return words if len(words) <= 64 else blake2b(words.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def parse(html: str, known: Words | None = None) -> Page:
    """Tokens and texts of a page. Every tag costs the same, at any depth."""
    known = Words() if known is None else known
    page, stack, fresh = Page(), [], True
    open_: dict[str, list[int]] = defaultdict(list)  # places of the open elements of a tag
    i, n = 0, len(html)

    def last(tags) -> int:
        return max((open_[t][-1] for t in tags if open_.get(t)), default=-1)

    def text(raw: str) -> None:
        nonlocal fresh
        if raw:
            value = unescape(raw)
            here = stack[-1] if stack else None
            page.nodes.append(Node(value, here, fresh, len(page.tokens)))
            if value.strip():
                fresh = False
                page.tokens.append(known["=", here.path if here else -1, _digest(" ".join(value.split()))])

    def close(k: int) -> None:
        nonlocal fresh
        while len(stack) > k:
            e = stack.pop()
            open_[e.tag].pop()
            page.tokens.append(known["/", e.path])
            fresh |= e.tag in BLOCKS

    while i < n:
        m = _MARK.search(html, i)
        if not m:
            text(html[i:])
            break
        text(html[i : m.start()])
        i = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        fresh |= tag in BLOCKS
        if m[1]:
            if open_.get(tag):
                close(open_[tag][-1])
            continue
        if tag in CLOSES_P and last("p") > last(("table", "button", "td", "li")):
            close(open_["p"][-1])
        if tag in SELF_CLOSING:
            k = last(SELF_CLOSING[tag])
            if k > last(("ul", "ol", "dl", "table", "select")):
                close(k)
        names = frozenset(x for _, v in _ATTRIBUTE.findall(m[3]) for x in v.strip("\"'").lower().split())
        above = stack[-1] if stack else None
        path = known["p", above.path if above else -1, tag]
        e = Element(tag, names, above, path, known["k", above.key if above else -1, tag, names], len(page.tokens))
        page.tokens.append(known["<", path, names])
        if tag in VOID or m[3].endswith("/"):
            continue
        open_[tag].append(len(stack))
        stack.append(e)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, i)
            text(html[i : end.start() if end else n])
            i = end.end() if end else n
            close(len(stack) - 1)
    return page


def equivalence_classes(sequences: list[list[int]]) -> list[list[int]]:
    """Valid classes: roles with one occurrence vector in half of the pages or more, in one order everywhere."""
    where: list[dict[int, list[int]]] = []
    vectors: dict[int, list[tuple]] = defaultdict(list)
    for i, s in enumerate(sequences):
        at: dict[int, list[int]] = defaultdict(list)
        for k, r in enumerate(s):
            at[r].append(k)
        where.append(at)
        for r, places in at.items():
            vectors[r].append((i, len(places)))
    need = max(2, (len(sequences) + 1) // 2)
    classes: dict[tuple, list[int]] = defaultdict(list)
    for r, v in vectors.items():
        if len(v) >= need:
            classes[tuple(v)].append(r)
    valid = []
    for vector, roles in classes.items():
        order: list[int] = []
        for i, times in vector:
            own = [r for _, r in sorted((k, r) for r in roles for k in where[i][r])]
            order = order or own[: len(roles)]
            if len(set(order)) < len(order) or own != order * times:
                break
        else:
            if len(roles) > 1:
                valid.append(order)
    return valid


def _once(sequences: list[list[int]], classes: list[list[int]]) -> list[int]:
    """The largest class that no page holds twice."""
    counts = [Counter(s) for s in sequences]
    return max((c for c in classes if all(n[c[0]] < 2 for n in counts)), key=len, default=[])


def slots_of(sequence: list[int], root: list[int]) -> list[int]:
    """For each token the number of the last root role up to it, -1 before the first."""
    place = {r: i for i, r in enumerate(root)}
    out, slot = [], -1
    for r in sequence:
        slot = place.get(r, slot)
        out.append(slot)
    return out


@dataclass
class Template:
    root: list[int]  # roles in order
    nested: dict[int, int]  # roles of the other valid classes, and the root slot that holds all of them
    sequences: list[list[int]]  # roles of the pages
    token: dict[int, int]  # the token that plays a role


def deduce(sequences: list[list[int]]) -> Template:
    """Root and nested classes; tokens are told apart by the root slots, and the fixed places in these, in which they occur."""
    token = {t: t for s in sequences for t in s}
    spare = max(token, default=0) + 1
    classes = equivalence_classes(sequences)
    root = _once(sequences, classes)
    for _ in range(ROUNDS):
        if not root:
            break
        member = set(root)
        follows = [root[0] in s for s in map(set, sequences)]
        slots = [slots_of(s, root) for s in sequences]
        counts: dict[tuple, list[int]] = defaultdict(list)
        for s, at, yes in zip(sequences, slots, follows):
            if yes:
                for key, n in Counter((r, k) for r, k in zip(s, at) if r not in member).items():
                    counts[key].append(n)
        fixed = {key for key, n in counts.items() if len(n) == sum(follows) and min(n) == max(n)}
        number: dict[tuple, int] = {}
        told = []
        for s, at, yes in zip(sequences, slots, follows):
            seen: Counter = Counter()
            roles = []
            for r, k in zip(s, at):
                if r in member or not yes:
                    roles.append(r)
                    continue
                seen[r, k] += 1
                role = (r, k, seen[r, k] if (r, k) in fixed else 0)
                if role not in number:
                    number[role] = spare
                    token[spare] = token[r]
                    spare += 1
                roles.append(number[role])
            told.append(roles)
        found = equivalence_classes(told)
        larger = _once(told, found)
        if len(larger) <= len(root):
            break
        sequences, classes, root = told, found, larger
    member = set(root)
    nested = {}
    for c in classes:
        own = set(c)
        if not own & member:
            held = {k for s in sequences for r, k in zip(s, slots_of(s, root)) if r in own}
            if len(held) == 1:
                nested |= dict.fromkeys(c, held.pop())
    return Template(root, nested, sequences, token)


def elements(template: Template, known: Words) -> list[tuple[int, int, str]]:
    """Paired tags of the root: places of the opening and the closing role, and the tag."""
    name = {n: key for key, n in known.items()}
    out, stack = [], []
    for i, r in enumerate(template.root):
        kind, path, *_ = name[template.token[r]]
        if kind == "<":
            stack.append((i, path))
        elif kind == "/":
            while stack and stack[-1][1] != path:
                stack.pop()
            if stack:
                out.append((stack.pop()[0], i, name[path][2]))
    return sorted(out)


def _own(page: Page, roles: list[int], words: set[int]) -> list[Node]:
    """Texts that are neither the template's words nor blank, a link or in furniture."""
    return [x for x in page.nodes if x.text.strip() and roles[x.at] not in words and not x.furniture and not (x.element and x.element.link)]


def region(pages: list[Page], template: Template, slots: list[list[int]], known: Words) -> tuple[int, int]:
    """First and last place of the root between which the main text lies; (-1, all) if no element holds most of it."""
    words = {*template.root, *template.nested}
    size: Counter = Counter()
    headings: dict[int, set] = defaultdict(set)
    for only_own in (True, False):
        for p, s, at in zip(pages, template.sequences, slots):
            for x in _own(p, s, words if only_own else set()):
                k = at[x.at - 1] if x.at else -1
                size[k] += len(x.text) * (2 if x.main else 1)
                e = x.element
                while e is not None and e.tag not in HEADINGS:
                    e = e.parent if e.tag not in BLOCKS else None
                if e is not None:
                    headings[k].add(x.text.strip())
        if size:
            break  # copies of one page have no text of their own: all of it counts
    before = np.concatenate([[0], np.cumsum([size[k] for k in range(-1, len(template.root))])])
    held = lambda lo, hi: before[hi + 1] - before[lo + 1]  # noqa: E731  text of the slots lo to hi - 1
    at, start = (-1, len(template.root)), -1
    for i, j, tag in elements(template, known):  # in order, so that the next one down comes before what is in it
        if not (at[0] < i and j < at[1] and tag in WAYS and 0 < SHARE * held(*at) <= held(i, j)):
            continue
        if start < 0 or start == at[0]:
            title = [k for k in headings if at[0] <= k < i and len(headings[k]) > 1]
            start = min(title, default=i)
        at = (i, j)
    return start, at[1]


def fixed_elements(pages: list[Page], template: Template, slots: list[list[int]], main: tuple[int, int]) -> set[int]:
    """Keys of elements inside the region that belong to the template: wherever they occur they hold only words of its classes,
    on half of the pages or more (three at least) that all differ in their own text, so copies of an article give none.
    A plain heading or paragraph is no element of its own here: it must have a name or be a container."""
    words = {*template.root, *template.nested}
    varied: set[int] = set()
    holders: dict[int, set] = defaultdict(set)
    for p, s, at in zip(pages, template.sequences, slots):
        own, held = [], set()
        seen: dict[bool, set[int]] = {True: set(), False: set()}
        for x in p.nodes:
            if not x.text.strip() or x.furniture or not main[0] <= (at[x.at - 1] if x.at else -1) < main[1]:
                continue
            fixed = s[x.at] in words
            keys, e = held if fixed else varied, x.element
            while e is not None and main[0] <= at[e.at] < main[1] and id(e) not in seen[fixed]:
                seen[fixed].add(id(e))
                if e.names or e.tag in CONTAINERS:
                    keys.add(e.key)
                e = e.parent
            if not fixed:
                own.append(x.text)
        for key in held:
            holders[key].add(tuple(own))
    need = max(3, (len(pages) + 1) // 2)
    return {key for key, texts in holders.items() if key not in varied and len(texts - {()}) >= need}


def _joined(page: Page, kept) -> str:
    """The texts of the kept nodes: one line a block, white space inside it as one space."""
    out: list[list[str]] = []
    fresh = True
    for x in page.nodes:
        fresh |= x.block
        if not kept(x):
            continue
        if fresh or not out:
            out.append([])
            fresh = False
        out[-1].append(x.text)
    blocks = (" ".join("".join(b).split()) for b in out)
    return "\n".join(b for b in blocks if b)


def _marked(nodes: list[Node]) -> bool:
    return any(x.main and not x.furniture and x.text.strip() for x in nodes)


def alone(page: Page) -> str:
    """Text of a page that has no template: without furniture, and inside a main mark if there is one."""
    inside = _marked(page.nodes)
    return _joined(page, lambda x: not x.furniture and (x.main or not inside))


def by_template(page: Page, at: list[int], roles: list[int], main: tuple[int, int], fixed: set[int], template: Template) -> str:
    slot = lambda x: at[x.at - 1] if x.at else -1
    inside = _marked([x for x in page.nodes if main[0] <= slot(x) < main[1]])

    known: dict[int, bool] = {}

    def in_fixed(e: Element | None) -> bool:
        up = []
        while fixed and e is not None and id(e) not in known and e.key not in fixed:
            up.append(id(e))
            e = e.parent
        found = bool(fixed) and e is not None and known.get(id(e), e.key in fixed)
        known.update(dict.fromkeys(up, found))
        return found

    text = _joined(page, lambda x: main[0] <= slot(x) < main[1] and not x.furniture and (x.main or not inside) and not in_fixed(x.element))
    if not text:
        own = {slot(x) for x in _own(page, roles, set(template.root))}
        text = _joined(page, lambda x: slot(x) in own and not x.furniture)
    return text


def group_texts(pages: list[Page], known: Words) -> list[str]:
    """Main texts of parsed pages. Those without the root's tokens do not follow the template and are a group of their own."""
    template = deduce([p.tokens for p in pages]) if len(pages) > 1 else None
    if not template or not template.root:
        return [alone(p) for p in pages]
    follows = [template.root[0] in s for s in template.sequences]
    fit = [p for p, yes in zip(pages, follows) if yes]
    rest = iter(group_texts([p for p, yes in zip(pages, follows) if not yes], known))
    template.sequences = [s for s, yes in zip(template.sequences, follows) if yes]
    slots = [slots_of(s, template.root) for s in template.sequences]
    main = region(fit, template, slots, known)
    fixed = fixed_elements(fit, template, slots, main)
    done = iter(by_template(p, at, s, main, fixed, template) for p, at, s in zip(fit, slots, template.sequences))
    return [next(done) if yes else next(rest) for yes in follows]


def extract_group(htmls: list[str]) -> list[str]:
    known = Words()
    return group_texts([parse(h or "", known) for h in htmls], known)


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages(page_id, url, html)``."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    p = pages.select(F.col("page_id").cast("bigint"), "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    big = p.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_PAGES)
    big = materialize(big.select("host", F.ceil(F.col("n") / GROUP_PAGES).alias("groups")))
    # pages are dealt once, by host and group: a join on the host alone would gather a frequent host in one task
    if big.count() <= BROADCAST_HOSTS:
        p = p.join(F.broadcast(big), "host", "left")
    else:
        p = p.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
        p = p.join(big.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))), ["host", "salt"], "left")
    p = p.withColumn("group", F.pmod(F.xxhash64("page_id"), F.coalesce("groups", F.lit(1).cast("bigint")))).select("page_id", "url", "html", "host", "group")

    def extract(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["page_id", "html"], kind="stable", na_position="first")
        texts = extract_group(pdf.html.tolist())
        return pd.DataFrame({"page_id": pdf.page_id.astype("Int64").values, "url": pdf.url.values, "text": texts, "n_chars": np.array([len(t) for t in texts], np.int64)})

    return p.groupBy("host", "group").applyInPandas(extract, "page_id bigint, url string, text string, n_chars bigint")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


QUERIES = {"op3_html_extraction": op3_html_extraction}
ORACLES: dict = {}
