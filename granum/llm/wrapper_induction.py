"""Main text of web pages by wrapper induction.

Pages of one host come from a few templates, told apart by the elements that hold others. A reference page is taken for
each, every different page of the template is aligned with it by simple tree matching, and counts are kept for each of
the reference's nodes. The wrapper judges nodes by these: a node that carries the same text on most pages is template;
a slot whose text varies is content, unless the votes against it win. Votes come from what an element says of itself
(navigation, forms, adverts, comments) and from links that are all it has; holding most of the template's varying text
is a vote for it. A page follows the verdicts of the nodes that its own are aligned with. Elements without a partner,
and pages of hosts that have too few for a wrapper, are judged by the same votes on the page alone.

Trees hold block elements only, and like siblings are folded until a tree has few enough nodes to be aligned in bounded
time and memory, whatever the page's length; folding loses no text. Only counts per node and one tree per different page
are shuffled.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granum.llm.common import maybe_broadcast, saved, ship
from granum.llm.url_filter import host_and_path

# HTML's elements by role, and words by which sites name what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea iframe svg math".split())
FOREIGN = frozenset("svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br img wbr".split())
OUT_TAGS = frozenset("head title nav header footer aside select button menu dialog noscript template object canvas".split())
#: Tags that count as names do: some sites have the whole page in a form. Elements that no name votes against.
WEAK_TAGS, TRUNK = frozenset(["form"]), frozenset("html body main article".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert".split())
OUT_WORDS = frozenset(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter"
    " notice notices popup promo related replies respond share sharing sidebar social sponsor sponsored subscribe widget widgets".split()
)
P_ENDS = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "thead": "tr td th", "tbody": "tr td th thead"}
CLOSES = {k: frozenset(v.split()) for k, v in CLOSES.items()}
#: Elements whose runs of like siblings are one node, so that lists and paragraphs of any number align; others only in runs over LONG_RUN.
FOLDED = frozenset("p li dt dd tr td th h1 h2 h3 h4 h5 h6 blockquote pre figure option".split())
SCOPE = frozenset("ul ol dl table body html div section article main td th nav".split())
#: Siblings beyond WIDE are folded by label in any order; what lies below the first MOST_NODES nodes is part of the node above.
LONG_RUN, WIDE, MOST_NODES = 30, 64, 1000
#: Elements nested deeper belong to the one at this depth, as in browsers.
MOST_DEPTH = 512

#: A tag: quotes count behind "=" only. No part is ever tried twice (possessive), so a tag costs its length.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""")
#: For what is left of a page in which a tag never ends by that pattern.
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
NAMES = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)""", re.I)
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>", re.I) for t in RAW}

MOST_SAME, LEAST_PAGES = 0.5, 3
#: Templates of a host that get a wrapper of their own; pages of further ones are aligned with the commonest.
MOST_SHAPES = 6
#: Votes: against an element by tag or role, by name, for links that are all it has; for the holder of most varying text.
BY_TAG, BY_NAME, BY_LINKS, FOR_TEXT = 2, 1, 2, 2
LINK_SHARE, LEAST_LINKS = 0.75, 3


class Node:
    __slots__ = ("label", "children", "blocks", "article", "vote", "links", "anchors")

    def __init__(self, label: str, article: bool, vote: int):
        self.label, self.children, self.blocks, self.article, self.vote, self.links, self.anchors = label, [], [], article, vote, 0, 0


class Row(NamedTuple):
    """A node of a folded tree, parents before children: its label, parent, hash and characters of its own text, those in links, links, in an article or not, votes against it by tag and name."""

    label: str
    parent: int
    text: int
    chars: int
    links: int
    anchors: int
    article: int
    vote: int


class Wrapper(NamedTuple):
    """A template's reference rows, and of each whether its text is template and whether it is outside the content."""

    shape: int
    rows: list[Row]
    constant: list[bool]
    out: list[bool]


def parse(page: str) -> tuple[Node, list[str]]:
    """The tree of block elements and the blocks of text, in page order; a node holds the numbers of its own blocks.

    Linear in the page. An unfinished tag or comment at the end has no text; a slash that closes a tag counts in
    foreign elements only, as in HTML.
    """
    root = Node("root", False, 0)
    stack: list[tuple[str, Node]] = [("root", root)]
    open_tags: Counter[str] = Counter()
    blocks: list[str] = []
    run: list[str] = []
    linked = anchors = 0
    in_link = False

    def flush() -> None:
        nonlocal linked, anchors
        text = " ".join(html.unescape("".join(run)).split()) if run else ""
        run.clear()
        if text:
            node = stack[-1][1]
            node.blocks.append(len(blocks))
            node.links += min(linked, len(text))
            node.anchors += anchors
            blocks.append(text)
        linked = anchors = 0

    def pop(to: int) -> None:
        for tag, _ in stack[to:]:
            open_tags[tag] -= 1
        del stack[to:]

    at, size, tags = 0, len(page), TAG
    while at < size:
        lt = page.find("<", at)
        text = page[at : lt if lt >= 0 else size]
        if text:
            run.append(text)
            if in_link:
                linked += len(text)
        if lt < 0:
            break
        ahead = page[lt + 1 : lt + 2]
        if ahead in ("!", "?"):
            close = page.find("-->", lt + 2) + 2 if page.startswith("<!--", lt) else page.find(">", lt)
            if close < 2:
                break
            at = close + 1
            continue
        after = page[lt + 2 : lt + 3] if ahead == "/" else ahead
        if not (after.isascii() and after.isalpha()):
            run.append("<")
            at = lt + 1
            continue
        m = tags.match(page, lt)
        if m is None and tags is TAG:
            tags = PLAIN_TAG
            m = tags.match(page, lt)
        if m is None:
            break
        at = m.end()
        end, tag, rest = m[1], m[2].lower(), m[3]
        if tag in RAW:
            if not end and not (tag in FOREIGN and rest.endswith("/")):
                close = RAW_END[tag].search(page, at)
                at = close.end() if close else size
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = not end
                anchors += not end
            elif tag in ("br", "img"):
                run.append(" ")
            continue
        flush()
        if tag in VOID:
            continue
        if end:
            if open_tags[tag]:
                pop(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag))
            continue
        if tag in P_ENDS and stack[-1][0] == "p":
            pop(len(stack) - 1)
        elif any(open_tags[t] for t in CLOSES.get(tag, ())):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in CLOSES[tag]:
                    pop(i)
                elif stack[i][0] in SCOPE:
                    break
        if tag in ("html", "body"):
            outer = [x for x in stack[1:] if x[0] == "html"]
            pop(1)
            for x in outer:
                stack.append(x)
                open_tags[x[0]] += 1
        if len(stack) > MOST_DEPTH:
            continue
        up = stack[-1][1]
        named = {k.lower(): v.strip("\"'").lower() for k, v in NAMES.findall(rest)} if rest else {}
        article = up.article or tag in ("article", "main")
        trunk = tag in TRUNK and not (tag == "article" and up.article)  # an article in another may be a comment
        vote = BY_TAG if tag in OUT_TAGS and not (tag == "header" and up.article) or not trunk and named.get("role") in OUT_ROLES else 0
        if not vote and not trunk:
            words = set(re.split(r"[^a-z0-9]+", f"{named.get('class', '')} {named.get('id', '')}")) if named else ()
            vote = BY_NAME if tag in WEAK_TAGS or not OUT_WORDS.isdisjoint(words) else 0
        first = named.get("class", "").split()
        name = f"#{re.sub('[0-9]+', '0', named['id'])}" if named.get("id") and tag not in FOLDED else ""
        node = Node((f"{tag}{name}.{first[0]}" if first else tag + name) + "!" * vote, article, vote)
        up.children.append(node)
        stack.append((tag, node))
        open_tags[tag] += 1
    flush()
    return root, blocks


def bare(label: str) -> str:
    return re.split("[#.!]", label, maxsplit=1)[0]


def grouped(children: list[Node]) -> list[list[Node]]:
    """Siblings as the nodes that they become: runs of one label are one; beyond WIDE all of one label, or of one tag, or all."""
    runs: list[list[Node]] = []
    for c in children:
        if runs and runs[-1][0].label == c.label:
            runs[-1].append(c)
        else:
            runs.append([c])
    groups = [g for r in runs for g in ([r] if bare(r[0].label) in FOLDED or len(r) > LONG_RUN else [[c] for c in r])]
    for key in (lambda c: c.label, lambda c: (bare(c.label), c.vote), lambda c: c.vote):
        if len(groups) <= WIDE:
            break
        merged: dict = defaultdict(list)
        for c in children:
            merged[key(c)].append(c)
        groups = list(merged.values())
    return groups


def skeleton(root: Node, blocks: list[str]) -> tuple[list[Row], list[list[int]]]:
    """The folded tree, at most MOST_NODES nodes from the root down, and the numbers of each node's blocks."""
    rows: list[Row] = []
    own: list[list[int]] = []
    todo: deque[tuple[list[Node], int]] = deque([([root], -1)])
    planned = 1
    while todo:
        group, parent = todo.popleft()
        below = [c for g in group for c in g.children]
        parts = grouped(below)
        whole = list(group)
        if planned + len(parts) > MOST_NODES:
            parts = []
            while below:
                n = below.pop()
                whole.append(n)
                below += n.children
        planned += len(parts)
        numbers = sorted(b for g in whole for b in g.blocks)
        text = "\n".join([blocks[b] for b in numbers])
        rows.append(Row(group[0].label, parent, xxhash.xxh3_64_intdigest(text) >> 1 if text else 0, len(text), sum(g.links for g in whole), sum(g.anchors for g in whole), int(any(g.article for g in group)), group[0].vote))
        own.append(numbers)
        todo += [(p, len(rows) - 1) for p in parts]
    return rows, own


def shape(rows: list[Row]) -> int:
    """What pages of one template share: the paths of the elements that hold others, without paragraphs and what is in articles."""
    paths, kept = [""] * len(rows), set()
    for i, r in enumerate(rows):
        paths[i] = f"{paths[r.parent]}/{r.label}"[-2000:] if r.parent >= 0 else r.label
        if not r.article and bare(r.label) not in FOLDED:
            kept.add(paths[i])
    return xxhash.xxh3_64_intdigest("\n".join(sorted(kept))) >> 1


def align(a: list[Row], b: list[Row]) -> list[tuple[int, int]]:
    """Simple tree matching: pairs of nodes of two skeletons, as many as labels, order and ancestry allow; equal texts count twice."""
    if len(a) == len(b) and all(x.label == y.label and x.parent == y.parent for x, y in zip(a, b)):
        return [(i, i) for i in range(len(a))]
    below = [[[] for _ in t] for t in (a, b)]
    for kids, t in zip(below, (a, b)):
        for i, x in enumerate(t):
            if x.parent >= 0:
                kids[x.parent].append(i)
    known: dict[tuple[int, int], tuple[int, list]] = {}
    todo = [(0, 0)]
    while todo:  # children first, without recursion: pages may be nested deeply
        i, j = todo[-1]
        if (i, j) in known:
            todo.pop()
            continue
        ka, kb = below[0][i], below[1][j]
        pairs = [(x, y) for x in ka for y in kb if a[x].label == b[y].label]
        if waiting := [p for p in pairs if p not in known]:
            todo += waiting
            continue
        todo.pop()
        best = 1 + (a[i].text == b[j].text != 0)
        if not pairs:
            known[i, j] = (best, [])
            continue
        table = [[0] * (len(kb) + 1) for _ in range(len(ka) + 1)]
        for x in range(1, len(ka) + 1):
            row, over = table[x], table[x - 1]
            for y in range(1, len(kb) + 1):
                w = known.get((ka[x - 1], kb[y - 1]))
                row[y] = max(over[y], row[y - 1], over[y - 1] + w[0] if w else 0)
        x, y, chosen = len(ka), len(kb), []
        while x and y:
            if table[x][y] == table[x - 1][y]:
                x -= 1
            elif table[x][y] == table[x][y - 1]:
                y -= 1
            else:
                chosen.append((ka[x - 1], kb[y - 1]))
                x, y = x - 1, y - 1
        known[i, j] = (best + table[-1][-1], chosen)
    out, todo = [], [(0, 0)]
    while todo:
        p = todo.pop()
        out.append(p)
        todo += known[p][1]
    return out


def outside(rows: list[Row], sums: list[tuple[int, int, int, int]], alone: bool = False, least: int = 1) -> list[bool]:
    """Which nodes are outside the content, by votes; `sums` has of each node pages with varying text, its characters, those in links, links.

    A node is outside with its parent, or if the votes against it (those under `least` don't count) outweigh that it
    holds most of the varying text. That counts only for elements with a marked article in them, where one is marked.
    A page that is judged alone may have links for its text: there they count against what other votes are against too.
    """
    below, marked = [list(s) for s in sums], [bool(r.article) for r in rows]
    for i in range(len(rows) - 1, 0, -1):
        up, own = below[rows[i].parent], below[i]
        up[0] = max(up[0], own[0])
        for k in (1, 2, 3):
            up[k] += own[k]
        marked[rows[i].parent] |= marked[i]
    out = [False] * len(rows)
    for i, r in enumerate(rows):
        pages, chars, links, anchors = below[i]
        against = r.vote if r.vote >= least else 0
        if not r.article and links >= LINK_SHARE * chars and anchors >= LEAST_LINKS * pages > 0 and (against or not alone):
            against += BY_LINKS
        most = 2 * chars > below[0][1] and (marked[i] or not marked[0])
        out[i] = i > 0 and out[r.parent] or against > (FOR_TEXT if most else 0)
    return out


def wrapper(shape_id: int, reference: list[Row], counts: list[dict]) -> Wrapper:
    """The verdicts of a template, from the counts per node of its pages."""
    constant, sums = [False] * len(reference), [(0, 0, 0, 0)] * len(reference)
    for c in counts:
        i = c["node"]
        constant[i] = c["same"] >= LEAST_PAGES and c["same"] > MOST_SAME * c["met"]
        if not constant[i]:
            sums[i] = c["filled"], c["chars"], c["links"], c["anchors"]
    return Wrapper(shape_id, reference, constant, outside(reference, sums))


def content(page: str | None, wrappers: list[Wrapper]) -> str:
    """The page's main text: the blocks of nodes that are neither template nor outside, joined by blank lines."""
    if not page:
        return ""
    root, blocks = parse(page)
    rows, own = skeleton(root, blocks)
    if wrappers:
        like = shape(rows)
        w = next((w for w in wrappers if w.shape == like), wrappers[0])
        partner = {j: i for i, j in align(w.rows, rows)}
        out, template = [False] * len(rows), [False] * len(rows)
        for j, r in enumerate(rows):
            i = partner.get(j)
            out[j] = w.out[i] if i is not None else out[r.parent] or r.vote > 0
            template[j] = i is not None and w.constant[i] and w.rows[i].text == r.text
        kept = [j for j in range(len(rows)) if own[j] and not template[j] and not out[j]]
        if not kept:  # nothing but what names alone put outside
            out = outside(rows, [(0, 0, 0, 0) if t else (1, r.chars, r.links, r.anchors) for r, t in zip(rows, template)], True, BY_TAG)
            kept = [j for j in range(len(rows)) if own[j] and not template[j] and not out[j]]
    else:
        for least in (1, BY_TAG):
            out = outside(rows, [(1, r.chars, r.links, r.anchors) for r in rows], True, least)
            kept = [j for j in range(len(rows)) if own[j] and not out[j]]
            kept = [j for j in kept if rows[j].article] or kept
            if kept:
                break
    return "\n\n".join(blocks[b] for b in sorted(b for j in kept for b in own[j]))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_hosts: int = 20_000) -> DataFrame:
    """Per row: id, url, text ("" if none), n_chars (its code points).

    A null or empty html gives "". A null or malformed url belongs to the empty host, whose pages share a wrapper like
    any other's. Hosts with fewer than LEAST_PAGES different pages have no wrapper, and their pages are judged alone: the
    marked article if there is one. Copies of a page count once in its host's wrapper, so an article repeated on a host is
    not taken for its template. Repeated rows give repeated results, an empty table an empty one; other columns are ignored.

    Pages are parsed twice rather than kept. Wrappers are broadcast under `broadcast_hosts` hosts, else joined.
    """
    ship(pages.sparkSession)
    host, _ = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {}
            for h, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if page:
                    flat, _ = skeleton(*parse(page))
                    code = json.dumps(flat, ensure_ascii=False, separators=(",", ":"))
                    seen[h, xxhash.xxh3_64_intdigest(code) >> 1] = code, shape(flat)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64()), pa.array([v[0] for v in seen.values()], pa.string())],
                names=["host", "sig", "shape", "code"],
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple, list[int]] = defaultdict(lambda: [0] * 6)
            references: dict[tuple, list[Row]] = {}
            for h, code, number, ref in zip(*(c.to_pylist() for c in batch.columns)):
                if (h, number) not in references:
                    references[h, number] = read_rows(ref)
                a, b = references[h, number], read_rows(code)
                for i, j in align(a, b):
                    if a[i].text or b[j].text:
                        s = sums[h, number, i]
                        s[0] += a[i].text != 0
                        s[1] += a[i].text == b[j].text
                        s[2] += b[j].chars > 0
                        s[3] += b[j].chars
                        s[4] += b[j].links
                        s[5] += b[j].anchors
            keys = list(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), *[pa.array([sums[k][x] for k in keys], pa.int64()) for x in range(6)]],
                names=["host", "number", "node", *COUNTS],
            )

    outlines = rows.select("host", "html").mapInArrow(outline, "host string, sig bigint, shape bigint, code string")
    outlines = saved(outlines.groupBy("host", "sig").agg(F.first("shape").alias("shape"), F.first("code").alias("code")))
    shapes = outlines.groupBy("host", "shape").agg(F.count("*").alias("n"), F.min_by("code", F.struct(F.xxhash64("sig"), "sig")).alias("reference"))
    ranked = shapes.groupBy("host").agg(F.sum("n").alias("pages"), F.max_by(F.struct("shape", "n", "reference"), F.struct("n", "shape")).alias("top"))
    firsts = saved(ranked.where(F.col("pages") >= LEAST_PAGES).select("host", F.col("top.shape").alias("shape"), F.col("top.reference").alias("reference"), F.lit(0).alias("number")))
    others = shapes.where(F.col("n") >= LEAST_PAGES).join(firsts.select("host", F.col("shape").alias("_first")), "host").where("shape <> _first")
    others = others.withColumn("number", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "shape"))).where(F.col("number") < MOST_SHAPES)
    templates = saved(firsts.union(others.select("host", "shape", "reference", "number")))
    own = maybe_broadcast(templates.where("number > 0").select("host", "shape", "number"), broadcast_hosts)
    asked = outlines.join(own, ["host", "shape"], "left").withColumn("number", F.coalesce("number", F.lit(0)))
    asked = asked.join(maybe_broadcast(templates.select("host", "number", "reference"), broadcast_hosts), ["host", "number"])
    counted = asked.select("host", "code", "number", "reference").mapInArrow(count, "host string, number int, node int" + "".join(f", {c} bigint" for c in COUNTS))
    counted = counted.groupBy("host", "number", "node").agg(*[F.sum(c).alias(c) for c in COUNTS])
    nodes = counted.groupBy("host", "number").agg(F.collect_list(F.struct("node", *COUNTS)).alias("nodes"))
    kept = templates.join(nodes, ["host", "number"], "left").select("host", F.struct("number", "shape", "reference", "nodes").alias("t"))
    wrappers = saved(kept.groupBy("host").agg(F.sort_array(F.collect_list("t")).alias("templates")))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[Wrapper]] = {}
        for batch in batches:
            texts = []
            hosts, found = batch.column(3).to_pylist(), batch.column(4)
            for i, page in enumerate(batch.column(2).to_pylist()):
                if hosts[i] not in known:
                    if len(known) > 2000:
                        known.clear()
                    known[hosts[i]] = [wrapper(t["shape"], read_rows(t["reference"]), t["nodes"] or []) for t in found[i].as_py() or []]
                texts.append(content(page, known[hosts[i]]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], names=["id", "url", "text"])

    joined = rows.join(maybe_broadcast(wrappers, broadcast_hosts), "host", "left").select("id", "url", "html", "host", "templates")
    out = joined.mapInArrow(extract, f"id {dict(pages.dtypes)[id_col]}, url {dict(pages.dtypes)[url_col]}, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))


#: Per node of a reference: pages where it has text and a partner, where that has the same, pages with text there, and sums of their characters and links.
COUNTS = ["met", "same", "filled", "chars", "links", "anchors"]


def read_rows(code: str) -> list[Row]:
    return [Row(*x) for x in json.loads(code)]
