"""Main text of web pages by wrapper induction.

Each page's DOM is reduced to an ordered tree of slots: a slot is a path of labels (tag, class
and id, long numbers dropped), siblings with one label are one slot, and each slot has a fingerprint
and a length of its own text. Pages of one host are aligned with reference pages by simple
tree matching: of the slots that two parents share, the heaviest sequence in the same order on
both sides is matched. Aligned slots vote: the same text speaks for template, different text for
content, with its length.

Copies of one article must not make it a template, so pages whose own text is the same do not
vote against each other, however much or little of the page it is. A page's own text is that of the slot with the most
characters times other texts that the host has for that slot, outside elements whose role says
otherwise. An own text of under ``least_own`` characters that is also under a tenth of its page (a
date, a line of advert) tells nothing about copies: such pages do not vote.

The votes of all pages of a host decide, slot by slot. A slot whose votes are nearly all equal is template:
its text, known by its fingerprint, is dropped wherever it stands. The content region is found
by going down from the root to the child that holds most of the host's varying text, as long as
there is one. The text of a page is that of its region, without template slots and without
elements whose role says otherwise (navigation, header, footer, sidebar, notice, advert, form,
script, style, reader comments). Roles and the tags article and main break ties, and they decide
alone on hosts whose pages gave no votes. Names that may also mark a part of the article
(related, share, subscribe ...) count inside a region only where most of the text is links.
Character references are decoded, white space inside a block becomes one space, blocks are
joined by one space in page order.

References are ``host_refs`` contents of each host and the first and last of each (host, layout),
chosen by hash: a fixed number of comparisons a page, while every page votes.

Plan: pages are scanned once for trees of some hundred bytes; texts of slots, references and votes are
grouped with partial aggregation. A page gets the decisions on the slots of its own layout, rare
or common, so that no row grows with its host; they are stored by host and layout, and
Spark broadcasts them if their measured size allows and joins by shuffle otherwise. The parsed page
is never shuffled unless that table is large. Parsing and matching are iterative and take time in
proportion to the page, whatever its depth or the number of siblings.

Defined cases: null and empty pages give an empty text; a page without tags is its whole text;
a null url is a host of its own; a host whose pages do not vote has no wrapper; a page that
would lose all its text to the wrapper is read without it; repeated rows are extracted alike
and vote once.
"""

from __future__ import annotations

import html as _html
import pickle
import re
from array import array
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .support import store
from .tokens import slices

_RAW = "script|style|noscript|template|textarea|svg|iframe|select"
_TOKEN = re.compile(rf"<!--.*?(?:-->|$)|<(?P<raw>{_RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|$)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*>|(?P<text>[^<]+|<)", re.S | re.I)
_ATTR = re.compile(r"([^\s\"'>/=]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_OUT_TAGS = frozenset("head nav footer aside form button dialog menu title option".split())
_MAIN_TAGS = frozenset(("article", "main"))
_ROLES_OUT = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_EDGES = r"(?:^|[\s_-])(?:{})(?:$|[\s_-])"
_OUT_NAMES = re.compile(
    _EDGES.format("ads?|adverts?|advertisements?|advertising|banners?|sponsor(?:ed|s)?|menus?|nav|navbar|navigation|topbar|toolbar|sidebars?|footers?|site-header|page-header|masthead|cookies?|consent|gdpr|notices?|comments?|commentlist|respond|replies|breadcrumbs?|popups?|modals?|overlays?|disqus"),
    re.I,
)
_MAYBE_NAMES = re.compile(_EDGES.format("promos?|promotions?|alerts?|share|sharing|social|related|newsletters?|subscribe|subscription|signup|widgets?|copyright|pagination|pager"), re.I)
_DIGITS = re.compile(r"\d{3,}")
#: Elements that hold blocks: only these can be a content region.
_BOXES = frozenset("# html body div section article main center table tbody tr td form fieldset".split())
#: Closed by the start of the tag: an open element of these kinds ends when the tag begins.
_CLOSES = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "body": {"head"}}
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


class Page:
    """Nodes of a page in order (parent, tag, slot, roles) and its (node, text) runs with block breaks."""

    def __init__(self, source: str, names: bool = True):
        self.names = names
        self.parent, self.tag, self.slot, self.out, self.maybe = [-1], ["#"], [0], [False], [False]
        self.sig, self.above = [_digest(0, "#")], [-1]  # of each slot: path digest, parent slot
        self.runs: list[tuple[int, str | None]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        parent, tag, slot, out, maybe, runs = self.parent, self.tag, self.slot, self.out, self.maybe, self.runs
        slots: dict[tuple[int, str], int] = {}
        inside, here = [False], 0
        opened: Counter = Counter()

        def leave(n: int) -> int:
            opened[tag[n]] -= 1
            return parent[n]

        for m in _TOKEN.finditer(source):
            text = m["text"]
            if text is not None:
                runs.append((here, text))
                continue
            name = m["tag"]
            if name is None:
                continue
            name = name.lower()
            if name not in _INLINE:
                runs.append((here, None))
            if m["end"]:
                if opened[name] > 0:
                    while tag[here] != name:
                        here = leave(here)
                    here = leave(here)
                continue
            if name in _VOID:
                continue
            if name == "p" or name in _HEADINGS:
                n = here  # a paragraph ends where the next block begins, through unclosed inline elements
                while tag[n] in _INLINE:
                    n = parent[n]
                if tag[n] == "p":
                    while here != n:
                        here = leave(here)
                    here = leave(here)
            elif name in _CLOSES and tag[here] in _CLOSES[name]:
                here = leave(here)
                if name == "tr" and tag[here] == "tr":
                    here = leave(here)
            label, role = "", ""
            if m["rest"]:
                for a in _ATTR.finditer(m["rest"]):
                    key = a[1].lower()
                    if key == "role":
                        role = (a[2] or a[3] or a[4] or "").lower()
                    elif key in ("class", "id"):
                        label += " " + (a[2] or a[3] or a[4] or "")
            named = self.names and label and name not in ("html", "body")
            bad = out[here] or name in _OUT_TAGS or role in _ROLES_OUT or (name == "header" and not inside[here]) or bool(named and _OUT_NAMES.search(label))
            key = (slot[here], name + _DIGITS.sub("#", label))
            if key not in slots:
                slots[key] = len(self.sig)
                self.sig.append(_digest(self.sig[slot[here]], key[1]))
                self.above.append(slot[here])
            parent.append(here)
            tag.append(name)
            slot.append(slots[key])
            out.append(bad)
            maybe.append(maybe[here] or bool(named and _MAYBE_NAMES.search(label)))
            inside.append(inside[here] or (not bad and (name in _MAIN_TAGS or role == "main")))
            here = len(parent) - 1
            opened[name] += 1
            if m["rest"].endswith("/") and name not in _INLINE and name not in ("p", "div", "article", "main", "section"):
                here = leave(here)
        self.inside = inside

    def own_texts(self) -> tuple[list[int], list[int]]:
        """Fingerprint (0 without text) and length of each slot's own text."""
        found: list[list[str]] = [[] for _ in self.sig]
        for n, t in self.runs:
            if t is not None and not t.isspace():
                found[self.slot[n]].append(t)
        texts = [" ".join(" ".join(x).split()) for x in found]
        return [_digest(1, x) if x else 0 for x in texts], [len(x) for x in texts]

    def text(self, wrapper: dict[int, tuple[int | None, float]] | None = None) -> str:
        """Main text, by the host's ``wrapper``: slot digest -> (template fingerprint or None, varying length)."""
        found = self._by_wrapper(wrapper) if wrapper else ""
        return found or self._by_roles()

    def _joined(self, use: list[bool]) -> str:
        return " ".join(_html.unescape("".join(" " if t is None else t for n, t in self.runs if t is None or use[n])).split())

    def _by_roles(self) -> str:
        whole = not any(self.inside)
        return self._joined([not o and not m and (whole or i) for o, m, i in zip(self.out, self.maybe, self.inside, strict=True)])

    def _by_wrapper(self, wrapper: dict[int, tuple[int | None, float]]) -> str:
        n_slots = len(self.sig)
        tags, bad = [""] * n_slots, [False] * n_slots
        for n, s in enumerate(self.slot):
            tags[s], bad[s] = self.tag[n], self.out[n]
        mass = [0.0 if b else wrapper.get(x, (None, 0.0))[1] for x, b in zip(self.sig, bad, strict=True)]
        children: list[list[int]] = [[] for _ in range(n_slots)]
        for s in range(n_slots - 1, 0, -1):
            mass[self.above[s]] += mass[s]
            children[self.above[s]].append(s)
        if not mass[0]:
            return ""
        region = 0
        while children[region]:
            best = max(children[region], key=lambda s: mass[s])
            if tags[best] not in _BOXES or mass[best] < 0.6 * mass[region]:
                break
            region = best
        held = [False] * n_slots
        for s in range(region, n_slots):
            held[s] = s == region or (s > 0 and held[self.above[s]])
        mains = [s for s in range(n_slots) if held[s] and s != region and tags[s] in _MAIN_TAGS and mass[s] >= 0.5 * mass[region]]
        if mains:  # slots come after their parents: the first is the outermost
            held = [s == mains[0] or (s > mains[0] and held[s]) for s in range(n_slots)]
            for s in range(mains[0] + 1, n_slots):
                held[s] = held[self.above[s]]
        own = self.own_texts()[0]
        gone = [own[s] != 0 and wrapper.get(x, (None, 0.0))[0] == own[s] for s, x in enumerate(self.sig)]
        links = self._link_lists() if any(self.maybe) else self.maybe
        return self._joined([held[s] and not gone[s] and not self.out[n] and not links[n] for n, s in enumerate(self.slot)])

    def _link_lists(self) -> list[bool]:
        """Nodes in an element whose name may say that it is no content and whose text is mostly links."""
        size, linked = [0] * len(self.parent), [0] * len(self.parent)
        in_link = [False] * len(self.parent)
        for n in range(1, len(self.parent)):
            in_link[n] = self.tag[n] == "a" or in_link[self.parent[n]]
        for n, t in self.runs:
            if t is not None:
                k = len(t.strip())
                size[n] += k
                linked[n] += k * in_link[n]
        for n in range(len(self.parent) - 1, 0, -1):
            size[self.parent[n]] += size[n]
            linked[self.parent[n]] += linked[n]
        out = [False] * len(self.parent)
        for n in range(1, len(self.parent)):
            out[n] = out[self.parent[n]] or (self.maybe[n] and not self.maybe[self.parent[n]] and 2 * linked[n] > size[n])
        return out


def _digest(seed: int, text: str | bytes) -> int:
    """A signed 64-bit digest, not 0."""
    return xxhash.xxh3_64_intdigest(text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass"), seed & 0xFFFFFFFFFFFFFFFF) - (1 << 63) or 1


def heaviest_increasing(places: list[int], weights: list[int]) -> list[int]:
    """Indexes of the heaviest strictly increasing subsequence of distinct ``places``, in n log n."""
    if all(a < b for a, b in zip(places, places[1:], strict=False)):
        return list(range(len(places)))
    rank = {p: i + 1 for i, p in enumerate(sorted(places))}
    tree: list[tuple[int, int]] = [(0, -1)] * (len(places) + 1)
    before, best = [-1] * len(places), (0, -1)
    for i, (p, w) in enumerate(zip(places, weights, strict=True)):
        at, top = rank[p] - 1, (0, -1)
        while at > 0:
            top, at = max(top, tree[at]), at & (at - 1)
        before[i], mine, at = top[1], (top[0] + w, i), rank[p]
        best = max(best, mine)
        while at <= len(places):
            tree[at] = max(tree[at], mine)
            at += at & -at
    out, i = [], best[1]
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def aligned(a: tuple[list[int], list[int]], b: tuple[list[int], list[int]]) -> list[tuple[int, int]]:
    """Simple tree matching of two slot trees (digests, parents; parents first): matched slot pairs.

    Slots with one digest have one path of labels, so they can only be matched with each other;
    among the shared children of two slots the heaviest sequence in common order is.
    """
    in_b = {x: j for j, x in enumerate(b[0])}
    shared = [in_b.get(x, -1) for x in a[0]]
    children: dict[int, list[int]] = {}
    for i in range(1, len(a[0])):
        if shared[i] >= 0:
            children.setdefault(a[1][i], []).append(i)
    weight = [1] * len(a[0])
    for i in range(len(a[0]) - 1, -1, -1):
        if i in children:
            own = children[i]
            children[i] = [own[x] for x in heaviest_increasing([shared[j] for j in own], [weight[j] for j in own])]
            weight[i] += sum(weight[j] for j in children[i])
    out, stack = [], [0] if shared and shared[0] >= 0 else []
    while stack:
        i = stack.pop()
        out.append((i, shared[i]))
        stack += children.get(i, ())
    return out


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))


def _packed(sig: list[int], above: list[int], prints: list[int], sizes: list[int]) -> bytes:
    return b"".join(array("q", x).tobytes() for x in (sig, above, prints, sizes))


def _unpacked(tree: bytes) -> tuple[list[int], list[int], list[int], list[int]]:
    flat = array("q")
    flat.frombytes(tree)
    n = len(flat) // 4
    return tuple(flat[i * n : (i + 1) * n].tolist() for i in range(4))


def _layout(page: Page) -> int:
    return _digest(2, array("q", page.sig).tobytes())


def _tree_maker(names: bool):
    """(host, content, layout, tree): digests of texts and of slots, and the packed slot tree of each page.

    Elements whose role says that they are no content have no length.
    """

    def trees(batches):
        for batch in (p for whole in batches for p in slices(whole, 1)):
            layouts, content, rows = [], [], []
            for source in batch.column(1).to_pylist():
                page = Page(source or "", names)
                prints, sizes = page.own_texts()
                for slot, bad in zip(page.slot, page.out, strict=True):
                    if bad:
                        sizes[slot] = 0
                rows.append(_packed(page.sig, page.above, prints, sizes))
                layouts.append(_layout(page))
                content.append(_digest(3, rows[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.int64()), pa.array(layouts, pa.int64()), pa.array(rows, pa.binary())], names=["host", "content", "layout", "tree"])

    return trees


def _slots(batches):
    """(host, content, slot, print, size, whole) of every slot with text; ``whole`` is the length of the page's text."""
    for batch in (p for many in batches for p in slices(many, 2)):
        rows = []
        for host, content, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            sig, _, prints, sizes = _unpacked(packed)
            whole = sum(sizes)
            rows += [(host, content, x, p, n, whole) for x, p, n in zip(sig, prints, sizes, strict=True) if n]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i else pa.string()) for i, c in enumerate(zip(*rows, strict=True) if rows else [[]] * 6)], names=["host", "content", "slot", "print", "size", "whole"])


def _layout_slots(batches):
    """(host, layout, slot) of every slot of a layout."""
    for batch in batches:
        rows = [(host, layout, x) for host, layout, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for x in _unpacked(packed)[0]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i else pa.string()) for i, c in enumerate(zip(*rows, strict=True) if rows else [[]] * 3)], names=["host", "layout", "slot"])


def _votes(batches):
    """(host, slot, print, n, size): votes for a constant text, or with a null print for varying text."""
    known: dict = {}
    trees: dict = {}

    def tree(data: bytes):
        if data not in trees:
            if len(trees) > 500:
                trees.clear()
            trees[data] = _unpacked(data)
        return trees[data]

    for batch in batches:
        votes: dict[tuple, list[int]] = {}
        for host, content, layout, own, packed, refs in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            sig, above, prints, sizes = _unpacked(packed)
            for ref in refs:
                if ref["content"] == content or ref["own"] == own:
                    continue  # copies of one article: no evidence of what is template
                other = tree(ref["tree"])
                key = (layout, ref["layout"])
                if key not in known:
                    if len(known) > 2000:
                        known.clear()
                    known[key] = aligned((sig, above), other[:2])
                pairs = [(i, prints[i] == other[2][j]) for i, j in known[key] if prints[i] or other[2][j]]
                for i, same in pairs:
                    vote = votes.setdefault((host, sig[i], prints[i] if same else None), [0, 0])
                    vote[0] += 1
                    vote[1] += sizes[i]
        rows = list(votes.items())
        columns = [pa.array([k[0] for k, _ in rows], pa.string()), *(pa.array([k[x] for k, _ in rows], pa.int64()) for x in (1, 2)), *(pa.array([v[x] for _, v in rows], pa.int64()) for x in (0, 1))]
        yield pa.RecordBatch.from_arrays(columns, names=["host", "slot", "print", "n", "size"])


def _own_texts(contents: DataFrame, least_own: int) -> DataFrame:
    """(host, content, own): the fingerprint of the text that makes a page differ from others of its host."""
    texts = contents.select("host", "content", "tree").mapInArrow(_slots, "host string, content bigint, slot bigint, print bigint, size bigint, whole bigint")
    others = texts.groupBy("host", "slot", "print").agg(F.lit(1).alias("one")).groupBy("host", "slot").agg((F.count("*") - 1).alias("others")).where("others > 0")
    best = F.max(F.struct((F.col("size") * F.col("others")).alias("weight"), "size", "print", "whole")).alias("best")
    found = texts.join(store(others), ["host", "slot"]).groupBy("host", "content").agg(best)
    return found.where((F.col("best.size") >= least_own) | (10 * F.col("best.size") >= F.col("best.whole"))).select("host", "content", F.col("best.print").alias("own"))


def induce(pages: DataFrame, *, least_votes: int = 2, same_share: float = 0.9, host_refs: int = 4, least_own: int = 100, names: bool = True) -> DataFrame:
    """(host, layout, wrapper): for each layout of a host whose pages vote, its slots with template fingerprint or null
    and mean varying length."""
    slim = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    contents = store(slim.mapInArrow(_tree_maker(names), "host string, content bigint, layout bigint, tree binary").dropDuplicates(["host", "content"]))
    voters = store(contents.join(store(_own_texts(contents, least_own)), ["host", "content"]))
    ref = F.struct(F.xxhash64("content").alias("o"), "content", "layout", "own", "tree")
    by_host = voters.groupBy("host", F.pmod(F.xxhash64("content", F.lit(7)), F.lit(host_refs)).alias("part")).agg(F.min(ref).alias("r")).groupBy("host").agg(F.collect_list("r").alias("refs"))
    by_layout = voters.groupBy("host", "layout").agg(F.min(ref).alias("lo"), F.max(ref).alias("hi")).where("lo.content <> hi.content").select(F.col("host").alias("host2"), F.col("layout").alias("layout2"), F.array("lo", "hi").alias("near"))
    by_host, by_layout = store(by_host), store(by_layout)
    asked = voters.join(by_host, "host").join(by_layout, (F.col("host") == F.col("host2")) & (F.col("layout") == F.col("layout2")), "left")
    asked = asked.select("host", "content", "layout", "own", "tree", F.array_distinct(F.concat("refs", F.coalesce("near", F.expr("array()")))).alias("refs"))
    votes = asked.mapInArrow(_votes, "host string, slot bigint, print bigint, n bigint, size bigint").groupBy("host", "slot", "print").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    slots = votes.groupBy("host", "slot").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("print").isNull(), F.col("size")).otherwise(0)).alias("varying"), F.max(F.when(F.col("print").isNotNull(), F.struct("n", "print"))).alias("top"))
    fixed = F.when((F.col("n") >= least_votes) & (F.col("top.n") >= same_share * F.col("n")), F.col("top.print"))
    decided = store(slots.select("host", F.struct("slot", fixed.alias("print"), (F.col("varying") / F.col("n")).alias("mass")).alias("x")).where("x.print is not null or x.mass > 0").select("host", F.col("x.slot").alias("slot"), "x"))
    layouts = contents.groupBy("host", "layout").agg(F.min("tree").alias("tree")).mapInArrow(_layout_slots, "host string, layout bigint, slot bigint")
    return layouts.join(decided, ["host", "slot"]).groupBy("host", "layout").agg(F.sort_array(F.collect_list("x")).alias("wrapper"))


def main_text(pages: DataFrame, *, names: bool = True, **parameters) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    Without ``names`` class and id names say nothing about roles.
    """
    wrappers = store(induce(pages, names=names, **parameters).withColumnsRenamed({"host": "_host", "layout": "_layout"}))

    def parse(batches):
        for batch in (p for whole in batches for p in slices(whole, 3)):
            parsed = [Page(source or "", names) for source in batch.column(3).to_pylist()]
            held = pa.array([pickle.dumps(page, 5) for page in parsed], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array([_layout(page) for page in parsed], pa.int64()), held], names=["page_id", "url", "host", "layout", "page"])

    def extract(batches):
        for batch in (p for whole in batches for p in slices(whole, 2)):
            texts = []
            for page, slots in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                texts.append(pickle.loads(page).text({x["slot"]: (x["print"], x["mass"]) for x in slots} if slots else None))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    slim = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), host_of(F.col("url")).alias("host"), F.col("html").cast("string"))
    parsed = slim.mapInArrow(parse, "page_id long, url string, host string, layout long, page binary")
    joined = parsed.join(wrappers, (F.col("host") == F.col("_host")) & (F.col("layout") == F.col("_layout")), "left").select("page_id", "url", "page", "wrapper")
    return joined.mapInArrow(extract, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
