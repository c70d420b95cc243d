"""Main text of web pages by wrapper induction.

Pages of a host share a wrapper. Every page is parsed once, to a skeleton (block elements with their
class, id and role names; runs of equal siblings folded to one slot) and the texts of its slots; that is
what all later steps read. A host's reference is the skeleton most of its distinct pages have, and the
others are aligned with it by simple tree matching, so that slots of different pages correspond.

Over a host's distinct pages each slot is counted: a slot whose whole text is the same on at least
CONSTANT of them is template, what varies is content. The content region is the part of the reference
that holds the varying text, less what lies in links and under elements and names of boilerplate; where
the host's pages mark their article (article, main, role=main), that mark decides among the slots. What
is aligned with the region is the page's text. Blocks without a counterpart count if they stand beside
the region and bear no name of boilerplate. Inside the region only menus, footers, sidebars, notices,
adverts, forms, reader comments and the like go; of an article nothing else is dropped, neither its
headings nor what it has in common with others.

Counts are summed per task before the shuffle and by slot and page, so a host with a third of all pages
costs no more than others. Wrappers (a skeleton and a few numbers a host) are broadcast after a check of
their size, and joined by host beyond it.

Defined cases: null and empty html give the empty text; a null url belongs to the host ''; a page of a
host with fewer than LEAST_PAGES distinct pages, or without any text in its host's region, is its own
reference, and no slot of it is template; repeated rows count once and all get a row; broken markup
closes what is open at its end; blocks nested deeper than DEPTH belong to the one at that depth.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import small_enough, staged

CONSTANT = 0.8
LEAST_PAGES = 4
DEPTH = 150
#: Pairs of children that are matched exactly; longer lists are matched in order, first come first served.
MATCHED = 1 << 20

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(script|style|noscript|template|textarea|svg|iframe|title|select)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: Elements that start a new block of text.
BLOCKS = frozenset(
    "html head body article section nav aside header footer main div p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd table caption thead tbody tfoot tr td th"
    " blockquote pre figure figcaption form fieldset legend address details summary dialog menu search center".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Block elements that never hold an article's text.
OUTSIDE = frozenset("head nav aside footer form fieldset dialog menu search".split())
HEADINGS = frozenset("h1 h2 h3 hgroup".split())
#: Elements that hold other blocks rather than text.
STRUCTURE = frozenset("# html body div section table tbody tr td center main article".split())
#: What an opening tag closes, if that is open nearer than a container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
CONTAINERS = frozenset("ul ol dl table body article section div".split())


def _names(words: str) -> re.Pattern:
    return re.compile(rf"(?:^|[\s_-])(?:{words})(?:$|[\s_-])", re.I)


#: Names that classes, ids and roles of boilerplate are made of: anywhere, and those that count inside a content region too.
INSIDE_WORDS = (
    r"nav|navbar|navigation|menu|menubar|footer|sidebar|aside|complementary|ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|popup|modal|overlay"
    r"|comments?|disqus|respond|replies|reply|share|sharing|social|breadcrumbs?|pagination|pager|related|recommended|newsletter|subscribe|signup|login|search|toolbar"
)
INSIDE_NAME = _names(INSIDE_WORDS)
OUTSIDE_NAME = _names(rf"{INSIDE_WORDS}|header|masthead|topbar|contentinfo|side|alert|follow|widgets?|tags|copyright|legal|skip")


class Page:
    """Blocks of a page: parallel lists of element name, label and parent; and (block, text, characters in links) in page order."""

    def __init__(self, html: str) -> None:
        self.tags, self.labels, self.parents, self.texts = ["#"], [""], [-1], []
        open_, pending, at, linked, in_link = [0], [], 0, 0, False

        def flush() -> None:
            nonlocal linked
            if pending:
                text = " ".join(unescape("".join(pending)).split())
                if text:
                    self.texts.append((open_[-1], text, min(linked, len(text))))
                pending.clear()
            linked = 0

        for m in TOKEN.finditer(html):
            if m.start() > at:
                pending.append(html[at : m.start()])
                linked += (m.start() - at) * in_link
            at = m.end()
            name = m[3]
            if name is None:
                continue
            name = name.lower()
            if name == "a":
                in_link = not m[2]
                continue
            if name in VOID:
                if name in ("br", "hr", "wbr"):
                    pending.append(" ")
                continue
            if name not in BLOCKS:
                continue
            flush()
            if m[2]:
                for k in range(len(open_) - 1, 0, -1):
                    if self.tags[open_[k]] == name:
                        del open_[k:]
                        break
                continue
            if self.tags[open_[-1]] == "p":
                open_.pop()
            closes = CLOSES.get(name)
            if closes:
                for k in range(len(open_) - 1, 0, -1):
                    tag = self.tags[open_[k]]
                    if tag in closes:
                        del open_[k:]
                        break
                    if tag in CONTAINERS:
                        break
            if len(open_) > DEPTH:
                continue
            label = ""
            if m[4].strip():
                found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(m[4])}
                if "hidden" in found or found.get("aria-hidden") == "true":
                    label = " banner "
                label += " ".join(found.get(k, "") for k in ("class", "id", "role")).strip()
            self.tags.append(name)
            self.labels.append(label)
            self.parents.append(open_[-1])
            open_.append(len(self.tags) - 1)
        if at < len(html):
            pending.append(html[at:])
            linked += (len(html) - at) * in_link
        flush()

    def skeleton(self) -> tuple[str, list[int]]:
        """The folded skeleton in preorder, and each block's slot in it."""
        children: list[list[int]] = [[] for _ in self.tags]
        for i, p in enumerate(self.parents[1:], 1):
            children[p].append(i)
        shape = [""] * len(self.tags)
        for i in range(len(self.tags) - 1, -1, -1):
            inner: list[str] = []
            for c in children[i]:
                if not inner or inner[-1] != shape[c]:
                    inner.append(shape[c])
            name = self.tags[i] + ("." + re.sub(r"[^\w-]+", ".", self.labels[i].strip()) if self.labels[i].strip() else "")
            shape[i] = f"{name}({','.join(inner)})" if inner else name
        slots, sizes = [0] * len(self.tags), {}

        def size(s: str) -> int:
            if s not in sizes:
                sizes[s] = 1 + s.count(",") + s.count("(")
            return sizes[s]

        for i in range(len(self.tags)):
            at, last = slots[i] + 1, None
            for c in children[i]:
                if last is not None and shape[c] != last:
                    at += size(last)
                slots[c], last = at, shape[c]
        return shape[0], slots


class Tree:
    """A skeleton: names and children of its slots in preorder, where each subtree ends, and what the names say."""

    def __init__(self, skeleton: str) -> None:
        self.names, self.children, self.parents, stack, last = [], [], [], [], -1
        for token in re.findall(r"[(),]|[^(),]+", skeleton):
            if token == "(":
                stack.append(last)
            elif token == ")":
                last = stack.pop()
            elif token != ",":
                last = len(self.names)
                self.names.append(token)
                self.children.append([])
                self.parents.append(stack[-1] if stack else -1)
                if stack:
                    self.children[stack[-1]].append(last)
        n = len(self.names)
        self.ends = list(range(1, n + 1))
        for i in range(n - 1, 0, -1):
            self.ends[self.parents[i]] = max(self.ends[self.parents[i]], self.ends[i])
        self.tags, self.outside, self.marked, self.noisy = [], [], [], []
        for i, name in enumerate(self.names):
            tag, _, label = name.partition(".")
            label, above = label.replace(".", " "), self.parents[i]
            marked = tag in ("article", "main") or ("main" in label.split() and tag in ("div", "section"))
            inside = above >= 0 and self.marked[above]
            names = (INSIDE_NAME if inside else OUTSIDE_NAME).search(label) and tag not in ("html", "body")
            self.tags.append(tag)
            self.noisy.append(tag in OUTSIDE or bool(INSIDE_NAME.search(label)))
            self.outside.append((above >= 0 and self.outside[above]) or bool(names) or tag in OUTSIDE or (tag == "header" and not inside))
            self.marked.append(not self.outside[i] and (inside or marked))

    def region(self, mass: list[int]) -> tuple[list[tuple[int, int]], bool]:
        """Preorder ranges of the slots that hold the content, and whether they are marked as such. ``mass`` is the content of each slot itself."""
        whole = [0 if o else m for m, o in zip(mass, self.outside, strict=True)]
        for i in range(len(whole) - 1, 0, -1):
            whole[self.parents[i]] += whole[i]
        tops = [i for i, m in enumerate(self.marked) if m and not self.marked[self.parents[i]] and whole[i]]
        if tops and 4 * sum(whole[i] for i in tops) >= whole[0]:
            out = []
            for i in tops:
                inner = [j for j in range(i + 1, self.ends[i]) if self.tags[j] == "article" and not self.outside[j]]
                inner = [j for j in inner if not any(k < j < self.ends[k] for k in inner)]
                held = inner if self.tags[i] != "article" and 5 * sum(whole[j] for j in inner) >= 4 * whole[i] else [i]
                out.extend((j, self.ends[j]) for j in held)
            return out, True
        at = 0
        while True:
            inner = [c for c in self.children[at] if self.tags[c] in STRUCTURE and 5 * whole[c] >= 4 * whole[at] > 0]
            if not inner or any(whole[j] and self.tags[j] in HEADINGS for j in range(at, self.ends[at]) if not inner[0] <= j < self.ends[inner[0]]):
                return [(at, self.ends[at])], False
            at = inner[0]


@lru_cache(4096)
def tree_of(skeleton: str) -> Tree:
    return Tree(skeleton)


@lru_cache(20_000)
def alignment(page: str, reference: str) -> tuple[int, ...]:
    """Slot of the reference for each slot of the page, or -1: the largest order-preserving matching of the two trees."""
    a, b = tree_of(page), tree_of(reference)
    memo: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def in_order(x: list[int], y: list[int]) -> list[tuple[int, int]]:
        out, q = [], 0
        for i in x:
            for k in range(q, min(q + 50, len(y))):
                if a.names[i] == b.names[y[k]]:
                    out.append((i, y[k]))
                    q = k + 1
                    break
        return out

    def best(x: list[int], y: list[int]) -> list[tuple[int, int]]:
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for p in range(1, len(x) + 1):
            for q in range(1, len(y) + 1):
                table[p][q] = max(table[p - 1][q], table[p][q - 1], table[p - 1][q - 1] + match(x[p - 1], y[q - 1]))
        out, p, q = [], len(x), len(y)
        while p and q:
            if table[p][q] == table[p - 1][q]:
                p -= 1
            elif table[p][q] == table[p][q - 1]:
                q -= 1
            else:
                p, q = p - 1, q - 1
                out.append((x[p], y[q]))
        return out

    def match(i: int, j: int) -> int:
        if a.names[i] != b.names[j]:
            return 0
        if (i, j) not in memo:
            x, y = a.children[i], b.children[j]
            pairs = best(x, y) if len(x) * len(y) <= MATCHED else in_order(x, y)
            memo[i, j] = (1 + sum(match(*p) for p in pairs), pairs)
        return memo[i, j][0]

    found = [-1] * len(a.names)
    stack = [(0, 0)] if match(0, 0) else []
    while stack:
        i, j = stack.pop()
        found[i] = j
        stack.extend(memo[i, j][1])
    return tuple(found)


def own_region(shape: str, slots: list[int], texts: list[str], links: list[int]) -> tuple[list[tuple[int, int]], bool]:
    """The region of a page that is its own reference."""
    mass = [0] * len(tree_of(shape).names)
    for s, t, n in zip(slots, texts, links, strict=True):
        mass[s] += len(t) - n
    return tree_of(shape).region(mass)


@lru_cache(50_000)
def kept_slots(shape: str, reference: str, ranges: tuple[tuple[int, int], ...], constant: tuple[int, ...]) -> list[bool]:
    """Per slot of a page whether its text is content."""
    page, to = tree_of(shape), alignment(shape, reference)
    above, tree = set(), tree_of(reference)
    for start, _ in ranges:
        i = tree.parents[start]
        while i >= 0:
            above.add(i)
            i = tree.parents[i]
    # What each slot stands for: in the region, beside it, or elsewhere; and whether a noisy block lies between it and the region.
    place, quiet, keep = [], [], []
    for i, r in enumerate(to):
        p = page.parents[i]
        if r >= 0:
            within = any(a <= r < b for a, b in ranges)
            here = "in" if within else "above" if r in above else "else"
        else:
            here = {"in": "in", "above": "beside", "beside": "beside", "else": "else"}[place[p]] if p >= 0 else "else"
        place.append(here)
        root = here == "in" and (p < 0 or place[p] != "in")
        quiet.append(here == "in" and (root or quiet[p]) and (root or not page.noisy[i]))
        keep.append((quiet[i] or (here == "beside" and not page.outside[i])) and r not in constant)
    return keep


def main_text(shape: str, slots: list[int], texts: list[str], links: list[int], wrapper: tuple | None) -> str:
    """The texts in the region of the host's ``wrapper`` (reference, ranges, constant slots), or of the page's own."""
    if wrapper is not None:
        keep = kept_slots(shape, *wrapper)
        if any(keep[s] for s in slots):
            return " ".join(t for s, t in zip(slots, texts, strict=True) if keep[s])
    keep = kept_slots(shape, shape, tuple(own_region(shape, slots, texts, links)[0]), ())
    return " ".join(t for s, t in zip(slots, texts, strict=True) if keep[s])


def host_of(url: str = "url") -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


PARSED = "struct<shape:string,slots:array<int>,texts:array<string>,links:array<int>>"


def parse_udf():
    """Column function: html -> skeleton, and slot, text and characters in links of every text."""

    @F.arrow_udf(PARSED)
    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            shapes, slots, texts, links, ends = [], [], [], [], [0]
            for html in pages.to_pylist():
                page = Page(html)
                shape, at = page.skeleton()
                shapes.append(shape)
                slots.extend(at[i] for i, _, _ in page.texts)
                texts.extend(t for _, t, _ in page.texts)
                links.extend(n for _, _, n in page.texts)
                ends.append(len(texts))
            cuts = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, v) for v in (pa.array(slots, pa.int32()), pa.array(texts, pa.string()), pa.array(links, pa.int32()))]
            yield pa.StructArray.from_arrays([pa.array(shapes, pa.string()), *lists], names=["shape", "slots", "texts", "links"])

    return parse


def references(parsed: DataFrame) -> DataFrame:
    """(host, reference, pages): the skeleton that most of a host's distinct pages have, and their number."""
    counted = parsed.groupBy("host", "page").agg(F.min("shape").alias("reference")).groupBy("host", "reference").agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by(F.col("reference"), F.struct("n", F.xxhash64("reference")))
    return counted.groupBy("host").agg(best.alias("reference"), F.sum("n").alias("pages")).filter(F.col("pages") >= LEAST_PAGES)


def slot_counts(parsed: DataFrame, refs: DataFrame) -> DataFrame:
    """(host, slot, n, same, mass): pages with text in a slot, how many have its commonest text, and characters outside links."""
    import xxhash

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for host, page, shape, slots, texts, links, reference in zip(*(c.to_pylist() for c in b.columns), strict=True):
                to, held = alignment(shape, reference), {}
                for s, t, n in zip(slots, texts, links, strict=True):
                    if to[s] >= 0:
                        slot = held.setdefault(to[s], [0])
                        slot[0] += len(t) - n
                        slot.append(t)
                rows.extend((host, page, s, xxhash.xxh64_intdigest(" ".join(x[1:])) - (1 << 63), x[0]) for s, x in held.items())
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "page", "slot", "text", "mass"])

    joined = parsed.join(small_enough(refs, F.octet_length("reference")), "host").select("host", "page", "shape", "slots", "texts", "links", "reference")
    rows = joined.mapInArrow(count, "host string, page long, slot int, text long, mass long")
    once = rows.groupBy("host", "slot", "text", "page").agg(F.max("mass").alias("mass"))
    alike = once.groupBy("host", "slot", "text").agg(F.count(F.lit(1)).alias("n"), F.sum("mass").alias("mass"))
    return alike.groupBy("host", "slot").agg(F.sum("n").alias("n"), F.max("n").alias("same"), F.sum("mass").alias("mass"))


def wrappers(parsed: DataFrame) -> DataFrame:
    """(host, reference, ranges, constant): where a host's content lies in its reference, and which slots of it are template."""
    refs = staged(references(parsed), "references")

    @F.arrow_udf("struct<ranges:array<array<int>>,constant:array<int>>")
    def learn(reference: pa.Array, slots: pa.Array) -> pa.Array:
        out = []
        for skeleton, found in zip(reference.to_pylist(), slots.to_pylist(), strict=True):
            tree = tree_of(skeleton)
            constant = sorted(x["slot"] for x in found if x["n"] >= LEAST_PAGES and x["same"] >= CONSTANT * x["n"])
            mass = [0] * len(tree.names)
            for x in found:
                mass[x["slot"]] = 0 if x["slot"] in constant and not tree.marked[x["slot"]] else x["mass"]
            ranges, marked = tree.region(mass)
            out.append({"ranges": [list(r) for r in ranges], "constant": [] if marked else constant})
        return pa.array(out, pa.struct([("ranges", pa.list_(pa.list_(pa.int32()))), ("constant", pa.list_(pa.int32()))]))

    listed = slot_counts(parsed, refs).groupBy("host").agg(F.collect_list(F.struct("slot", "n", "same", "mass")).alias("found"))
    return refs.join(listed, "host").select("host", "reference", learn("reference", "found").alias("w")).select("host", "reference", "w.*")


def extract_text(pages: DataFrame, induce: bool = True) -> DataFrame:
    """page_id, url, text, n_chars for every row. Without ``induce`` every page is its own reference."""
    body = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).select("page_id", "url", host_of().alias("host"), F.xxhash64("html").alias("page"), parse_udf()("html").alias("p"))
    parsed = staged(body.select("page_id", "url", "host", "page", "p.*"), "parsed")
    made = staged(wrappers(parsed), "wrappers") if induce else None

    @F.arrow_udf("string")
    def extract(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            out = []
            for shape, slots, texts, links, reference, ranges, constant in zip(*(c.to_pylist() for c in columns), strict=True):
                wrapper = None if reference is None else (reference, tuple(map(tuple, ranges)), tuple(constant))
                out.append(main_text(shape, slots, texts, links, wrapper))
            yield pa.array(out, pa.string())

    if made is None:
        joined = parsed.withColumns({"reference": F.lit(None).cast("string"), "ranges": F.lit(None).cast("array<array<int>>"), "constant": F.lit(None).cast("array<int>")})
    else:
        joined = parsed.join(small_enough(made, F.octet_length("reference") + 64), "host", "left")
    text = extract("shape", "slots", "texts", "links", "reference", "ranges", "constant")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
