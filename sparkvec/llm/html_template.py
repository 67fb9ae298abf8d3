"""HTML extraction by equivalence-class template deduction.

A page is a sequence of tokens: its tags, each told apart by its path from the root (class, id and role, and its place among
containers alike), and its blocks of text. Tokens of a host that occur equally often on each of its pages have the same
occurrence vector and form an equivalence class. Vectors are never built: each is summarised by sums of hashes of (page,
count) over all pages of the host, one partial aggregation, so a host of a third of all pages is no heavier for any task. A
class is valid if at least half of the host's pages carry it. Valid classes nest by their paths into the host's template:
containers bound slots, and blocks of text that are in valid classes are the template's own.

What the slots hold decides. A slot whose text mostly comes back on other pages of the host is template as well. Of
the others the main region is the innermost that holds ``DOMINANT`` of the host's remaining, unlinked text; directly below body,
slots of less than ``MINOR`` of the largest one go. Headings before the region stay. A host of one page is judged by
that page. Tag and class names come in where classes cannot tell, as with reader comments, which differ from page to page:
elements named as menus, headers, footers, side matter, notices, adverts, forms or comments bound no content unless they hold
the article, and the region extends to the article or main element around it.

Text keeps its order: character references are decoded, white space inside a block becomes one space, blocks are trimmed and
joined by two line feeds. Where a page has nothing but its template's text, it repeats another one's article, and keeps it.

Defined results: null html is empty and has an empty text; a null url is a host of its own; repeated pages are extracted
each for itself; an unclosed element, comment or quote hides no more than itself; time and memory are linear in a page, however
deep it nests; an empty table gives no rows; other columns are ignored. Templates are joined to pages by host; no page is collected.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkvec.llm.common import cut, table

#: Share of a host's pages that a valid class must occur on.
SUPPORT = 0.5
#: Pages that must carry a block of text before it can be the template's.
LEAST_PAGES = 5
#: Share of a slot's text that must come back on other pages for the slot to be template.
REPEATED = 0.5
#: Share of the text of what is around it that the main region holds; and of the largest slot that others below body must have.
DOMINANT = 0.75
MINOR = 0.2
#: Slots and texts of all hosts' templates that are broadcast, at most (under 250 bytes each); beyond that pages are joined by host.
MAX_BROADCAST = 100_000
#: Hosts whose numbers of pages are broadcast, at most; more are joined.
MAX_HOSTS = 200_000
#: A longer path is replaced by its hash, as is a longer name, so that a token has a bounded size at any depth.
PATH_CHARS = 200
NAME_CHARS = 80
#: Tokens that a worker sums before it passes them on.
HELD_TOKENS = 20_000
#: Places that containers alike are told apart by.
PLACES = 8

#: Elements whose content is not markup.
RAW = frozenset("script style textarea noscript template iframe title xmp noembed noframes".split())
#: A comment's start, a tag, a declaration, or text.
_TOKEN = re.compile(
    r"<!--|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?=>)|[^>]*+)>|<[!?][^>]*>|([^<]+|<)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_TELLS = re.compile(r"class|id|role|hidden|style", re.IGNORECASE)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that hold a text's own structure; all other blocks are containers, which bound slots.
PROSE = frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption hr table caption colgroup col thead tbody tfoot tr td th address details summary".split()
)
#: Elements whose start ends an open element of the kinds named.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: A paragraph ends where one of these starts, and so do elements that cannot hold them.
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
NO_BLOCKS = frozenset("svg math select button canvas".split())
SIDE_TAGS = frozenset("nav header footer aside form head script style noscript template iframe button select textarea dialog menu title svg math canvas noembed noframes".split())
SIDE_NAMES = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert[a-z]*|banner|sponsor(?:ed|s)?|promo[a-z]*|nav(?:bar|igation|links?)?|menu[a-z]*|breadcrumbs?|header|masthead|footer[a-z]*|sidebar[a-z]*|side-?bar|aside|widgets?|related|recommend(?:ed|ations)?"
    r"|cookie[a-z]*|consent|gdpr|notices?|notification|disclaimer|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|search|share|sharing|social|comment[a-z]*|replies|responses|respond|disqus|discussion"
    r"|complementary|contentinfo|pagination|pager|skip|copyright|toolbar|form)(?:[^a-z]|$)"
)
MAIN_TAGS = ("article", "main")
MAIN_NAMES = re.compile(r"(?:^|[^a-z])(?:article|main|content|post|entry|story|body-?text)(?:[^a-z]|$)")
_HEADER_NAME = re.compile(r"(?:^|(?<=[^a-z]))header(?=[^a-z]|$)")
_TOP = re.compile(r"(?:/html[^/]*)?(?:/body[^/]*)?")


def _names(attributes: str) -> tuple[str, bool]:
    """(class, id and role of a tag, whether it is hidden)."""
    if not _TELLS.search(attributes):
        return "", False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    names = " ".join(found[k] for k in ("class", "id", "role") if found.get(k)).lower()
    style = found.get("style", "").replace(" ", "").lower()
    return names, "display:none" in style or bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes)) or found.get("aria-hidden") == "true"


class Node:
    """An element. ``block`` and ``slot`` are the nearest block and container from it upwards; ``main`` the outermost article or
    main element around or at it, or else one of such a name."""

    __slots__ = ("barred", "block", "inside", "linked", "main", "named", "parent", "path", "seen", "side", "slot", "tag", "tagged", "volume")

    def __init__(self, tag: str, names: str, hidden: bool, parent: Node | None):
        self.tag, self.parent, self.seen, self.volume, self.inside = tag, parent, None, 0, False
        if parent is None:
            self.path, self.block, self.slot, self.main, self.tagged = "", self, self, None, False
            self.barred = self.named = self.side = self.linked = False
            return
        self.linked = parent.linked or tag == "a"
        self.main, self.tagged = parent.main, parent.tagged
        if tag in INLINE:
            self.path, self.block, self.slot = parent.path, parent.block, parent.slot
        else:
            own = f"{tag}.{names.replace(' ', '.').replace('/', '-').replace('#', '-').replace('~', '-')}" if names else tag
            if len(own) > NAME_CHARS:
                own = f"{tag[:20]}.{xxhash.xxh64_hexdigest(own)}"
            self.block = self.slot = self
            if tag in PROSE:
                self.slot = parent.slot
            else:
                above = parent.block
                above.seen = above.seen or {}
                place = above.seen[own] = above.seen.get(own, 0) + 1
                own += "" if place == 1 else f"~{place}" if place <= PLACES else "~"
            path = f"{parent.path}/{own}"
            self.path = path if len(path) <= PATH_CHARS else f"#{xxhash.xxh64_hexdigest(path)}"
        # An article's own header holds its title; pages' headers and footers do not.
        within = self.main is not None
        side_name = bool(names and tag not in ("html", "body", *MAIN_TAGS) and SIDE_NAMES.search(_HEADER_NAME.sub("", names) if within else names))
        self.barred = parent.barred or hidden or (tag in SIDE_TAGS and not (within and tag == "header"))
        self.named = side_name
        self.side = False  # set by Page
        if tag in MAIN_TAGS:
            if not self.tagged and not (names and SIDE_NAMES.search(names)):
                self.main, self.tagged = self, True
        elif not within and not side_name and names and tag not in ("html", "body") and MAIN_NAMES.search(names):
            self.main = self


def _tokens(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(slash, tag, attributes, text) of each tag or text. An element of raw content is a start tag with its end, if it has one."""
    at, ended = 0, set()
    match = _TOKEN.match
    while at < len(page):
        m = match(page, at)
        at = m.end()
        slash, tag, attributes, text = m.groups()
        if text is not None:
            yield "", "", "", text
        elif tag is None:
            if m[0] == "<!--":
                end = -1 if "-->" in ended else page.find("-->", at)
                if end < 0:
                    ended.add("-->")
                    end = page.find(">", at)
                    at = end + 1 if end >= 0 else at
                else:
                    at = end + 3
        else:
            tag = tag.lower()
            yield slash, tag, attributes, ""
            if tag in RAW and not slash and not attributes.endswith("/"):
                close = None if tag in ended else re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
                if close is None:
                    ended.add(tag)
                    at = m.end() if (end := page.find("<", at)) < 0 else end
                else:
                    at = close.end()
                yield "/", tag, "", ""


class Page:
    """The tree that a page's tokens imply: ``nodes`` in order, and ``pieces`` of text with their nodes, None where a block ends."""

    def __init__(self, page: str):
        root = Node("", "", False, None)
        self.nodes: list[Node] = [root]
        self.pieces: list[tuple[Node, str] | None] = []
        stack, opened = [root], {}

        def until(keep: int) -> None:
            while len(stack) > keep:
                gone = stack.pop()
                opened[gone.tag] -= 1
                if gone.tag not in INLINE:
                    self.pieces.append(None)

        def close(tags, stop_at_blocks: bool = False) -> None:
            """Close the innermost open element of ``tags``."""
            if not any(opened.get(t) for t in tags):
                return
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in tags:
                    return until(k)
                if stop_at_blocks and stack[k].tag not in INLINE and stack[k].tag != "p":
                    return None

        for slash, tag, attributes, text in _tokens(page):
            if text:
                self.pieces.append((stack[-1], text))
                continue
            if slash:
                close((tag,))
                continue
            if tag in ENDS_PARAGRAPH:
                if any(opened.get(t) for t in NO_BLOCKS):
                    close(NO_BLOCKS)
                close(("p",), stop_at_blocks=True)
            if tag in IMPLIED:
                close(IMPLIED[tag], stop_at_blocks=True)
            node = Node(tag, *(_names(attributes) if attributes else ("", False)), stack[-1])
            self.nodes.append(node)
            if tag == "br":
                self.pieces.append((stack[-1], " "))
            elif tag not in INLINE:
                self.pieces.append(None)
            if tag not in VOID and not attributes.endswith("/"):
                stack.append(node)
                opened[tag] = opened.get(tag, 0) + 1
        until(1)
        around = self._around()
        for node in self.nodes[1:]:
            node.side = node.barred or (node.named and node not in around) or node.parent.side

    def _around(self) -> set[Node]:
        """Elements that are side matter by name but hold the page's article: the main element with the most text. One without
        an article or main tag must also hold more than all slots that stay."""
        held: dict[Node, int] = {}
        plain = 0
        hidden: dict[Node, bool] = {self.nodes[0]: False}
        for node in self.nodes[1:]:
            hidden[node] = node.named or hidden[node.parent]
        for piece in self.pieces:
            if piece is not None and not piece[0].barred and (size := len(piece[1].strip())):
                node = piece[0]
                plain += 0 if hidden[node] else size
                if node.main is not None:
                    held[node.main] = held.get(node.main, 0) + size
        for node in sorted(held, key=lambda n: -held[n]):
            if not hidden[node]:
                break
            if node.tagged or held[node] > plain:
                out, above = set(), node.parent
                while above is not None:
                    if above.named:
                        out.add(above)
                    above = above.parent
                return out
        return set()

    def blocks(self) -> list[Block]:
        """The blocks of text outside side matter, in order."""
        out: list[Block] = []
        parts: list[str] = []
        owner, linked, plain = None, 0, 0

        def flush() -> None:
            nonlocal owner, linked, plain
            if parts:
                text = "".join(parts)
                text = " ".join((entities.unescape(text) if "&" in text else text).split())
                if text:
                    out.append(Block(text, owner, linked > plain))
                parts.clear()
            owner, linked, plain = None, 0, 0

        for piece in self.pieces:
            if piece is None:
                flush()
                continue
            node, text = piece
            if node.side:
                continue
            if owner is not node.block:
                flush()
                owner = node.block
            parts.append(text)
            size = len(text.strip())
            linked, plain = (linked + size, plain) if node.linked else (linked, plain + size)
        flush()
        return out


@dataclass(slots=True)
class Block:
    text: str
    owner: Node
    linked: bool

    @property
    def token(self) -> str:
        return f"{self.owner.slot.path}#{xxhash.xxh64_hexdigest(self.text)}"


@dataclass
class Slot:
    """A container of a template: the one around it, the unlinked text in and below it, the text directly in it, and what of
    that comes back on other pages."""

    above: str
    volume: int
    direct: int = 0
    again: int = 0


@dataclass
class Template:
    """The main region's path, the slots that go, and the tokens of text that go."""

    region: str
    slots: frozenset[str] = frozenset()
    texts: frozenset[str] = frozenset()


def page_slots(nodes: list[Node], blocks: list[Block]) -> dict[str, Slot]:
    """The containers of a page with the volume of their unlinked text."""
    for node in nodes:
        node.volume = 0
    out: dict[str, Slot] = {}
    direct: dict[str, int] = {}
    for b in blocks:
        if not b.linked:
            b.owner.slot.volume += len(b.text)
            direct[b.owner.slot.path] = direct.get(b.owner.slot.path, 0) + len(b.text)
    for node in reversed(nodes):
        if node.slot is node and not node.side:
            above = node.parent.slot if node.parent is not None else None
            if above is not None:
                above.volume += node.volume
            slot = out.setdefault(node.path, Slot(above.path if above is not None else "", 0, direct.get(node.path, 0)))
            slot.volume += node.volume
    return out


def nest(slots: dict[str, Slot], texts: dict[str, tuple[str, int]], pages: int = 1) -> Template:
    """The template of a host of ``pages`` pages from the slots and the texts (slot, characters) of its valid classes."""
    below: dict[str, list[str]] = {}
    for path, slot in slots.items():
        if path:
            below.setdefault(slot.above if slot.above in slots else "", []).append(path)
    order = [""]  # from the root outwards
    for path in order:
        order += below.get(path, ())
    own = dict.fromkeys(order, 0)
    again, direct = ({p: getattr(slots[p], k) if p in slots else 0 for p in order} for k in ("again", "direct"))
    for path, chars in texts.values():
        if path in own:
            own[path] += chars
    for path in reversed(order[1:]):
        above = slots[path].above if slots[path].above in slots else ""
        for sums in (own, again, direct):
            sums[above] += sums[path]
    volume = {p: (slots[p].volume if p in slots else sum(slots[q].volume for q in below.get(p, ()))) - own[p] for p in order}
    if volume[""] <= 0:  # all pages repeat each other
        volume = {p: v + own[p] for p, v in volume.items()}
    region = ""
    while best := max(below.get(region, ()), key=lambda p: (volume[p], p), default=None):
        if volume[best] <= 0 or volume[best] < DOMINANT * volume[region]:
            break
        region = best
    gone = set()
    if _TOP.fullmatch(region):
        inside = below.get(region, ())
        loose = volume[region] - sum(volume[p] for p in inside)
        largest = max([loose, *(volume[p] for p in inside)])
        gone.update(p for p in inside if volume[p] < MINOR * largest)
    if pages >= LEAST_PAGES and again[region] < REPEATED * direct[region]:
        held, path = {region}, region
        while path:
            path = slots[path].above if slots[path].above in slots else ""
            held.add(path)
        gone.update(p for p in order if p in slots and p not in held and direct[p] and again[p] >= REPEATED * direct[p])
    return Template(region, frozenset(gone), frozenset(texts))


def extract(page: str, template: Template | None = None) -> str:
    """The main text of a page, by its host's template or, where that does not fit it, by its own."""
    parsed = Page(page)
    blocks = parsed.blocks()
    if not blocks:
        return ""
    texts = template.texts if template else frozenset()
    fresh = [b for b in blocks if b.token not in texts] if texts else blocks
    fresh = fresh or blocks
    known = template
    if known is None or not _fits(parsed.nodes, fresh, known):
        own = nest(page_slots(parsed.nodes, fresh), {})
        known = Template(own.region, own.slots | (known.slots if known else frozenset()))
    kept = _in_region(parsed.nodes, fresh, known) or _in_region(parsed.nodes, fresh, Template(known.region)) or fresh
    return "\n\n".join(b.text for b in kept)


def _fits(nodes: list[Node], blocks: list[Block], template: Template) -> bool:
    """Does the region hold a fair share of a page's text?"""
    for node in nodes:
        node.inside = node.path == template.region or bool(node.parent and node.parent.inside)
    return sum(len(b.text) for b in blocks if b.owner.inside) >= MINOR * sum(len(b.text) for b in blocks)


def _in_region(nodes: list[Node], blocks: list[Block], template: Template) -> list[Block]:
    around, gone = set(), set()
    for node in nodes:
        if node.path == template.region and node.slot is node:
            around.add(node.main if node.main is not None else node)
    for node in nodes:
        node.inside = node in around or bool(node.parent and node.parent.inside)
        if node.path in template.slots and node not in around or node.parent in gone:
            gone.add(node)
    inside = [b for b in blocks if b.owner.inside and b.owner not in gone]
    tagged = [b for b in inside if b.owner.tagged]
    main = tagged or [b for b in inside if b.owner.main is not None]
    if tagged or 2 * sum(len(b.text) for b in main) > sum(len(b.text) for b in inside):
        return main
    kept = {id(b) for b in inside if not b.linked}
    if kept:
        for b in blocks:  # headings before the region
            if id(b) in kept:
                break
            if b.owner.tag in ("h1", "h2") and not b.linked:
                kept.add(id(b))
                break
    return [b for b in blocks if id(b) in kept]


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user or port; empty if there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:@]*)", 1)
    return F.lower(found)


_ROW = pa.schema([("host", pa.string()), ("token", pa.string()), ("kind", pa.string()), ("above", pa.string()), *[(c, pa.int64()) for c in ("n_pages", "n", "low", "high", "chars", "direct")]])


def page_tokens(page: str) -> dict[str, list]:
    """Each differentiated token of a page: its kind, the slot around it, how often it occurs, its characters of text (a slot's
    are the unlinked ones in and below it), and those directly in a slot."""
    parsed = Page(page)
    blocks = parsed.blocks()
    slots = page_slots(parsed.nodes, blocks)
    found: dict[str, list] = {}
    for node in parsed.nodes[1:]:
        if node.block is node:
            kind = "slot" if node.slot is node and not node.side else "tag"
            own = slots[node.path] if kind == "slot" else Slot("", 0)
            row = found.setdefault(node.path, [kind, node.parent.slot.path, 0, own.volume, own.direct])
            row[2] += 1
    for b in blocks:
        row = found.setdefault(b.token, ["text", b.owner.slot.path, 0, 0, 0])
        row[2] += 1
        row[3] += 0 if b.linked else len(b.text)
    found[""] = ["slot", "", 1, slots[""].volume, slots[""].direct]  # the page itself
    return found


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each host and token of some pages: pages, occurrences, characters, and two sums of hashes of (page, count)."""

    def rows(found: dict[tuple[str, str], list]) -> pa.RecordBatch:
        made = [(h, t, *s) for (h, t), s in found.items()]
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True) if made else [[]] * len(_ROW), _ROW, strict=True)], schema=_ROW)

    for batch in batches:
        found: dict[tuple[str, str], list] = {}
        for host, page_id, url, page in (tuple(x.as_py() for x in row) for row in zip(*batch.columns, strict=True)):
            hashes: dict[int, int] = {}
            for token, (kind, above, n, chars, direct) in page_tokens(page or "").items():
                if n not in hashes:
                    hashes[n] = xxhash.xxh64_intdigest(f"{page_id}\0{url}\0{n}")
                sums = found.setdefault((host, token), [kind, above, 0, 0, 0, 0, 0, 0])
                for k, v in enumerate((1, n, hashes[n] & 0x7FFFFFFF, hashes[n] >> 33, chars, direct), start=2):
                    sums[k] += v
            if len(found) > HELD_TOKENS:
                yield rows(found)
                found.clear()
        yield rows(found)


def _pages(pages: DataFrame) -> DataFrame:
    url = F.col("url").cast("string")
    return pages.select(host_of(url).alias("host"), "page_id", url.alias("url"), F.col("html").cast("string").alias("html"))


def equivalence_classes(pages: DataFrame, support: float = SUPPORT, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, host_pages, class, tokens): tokens with equal occurrence vectors that most pages of the host carry."""
    classes = _classes(pages, support, least_pages).select("host", "host_pages", "class", F.filter(F.transform("members", lambda m: m["token"]), lambda t: t != "").alias("tokens"))
    return classes.where(F.size("tokens") > 0)


def _classes(pages: DataFrame, support: float, least_pages: int) -> DataFrame:
    """(host, host_pages, class, members): the classes, the page itself among their members, with the members' slots and text."""
    rows = _pages(pages)
    numbers = ("n_pages", "n", "low", "high", "chars", "direct")
    summed = (
        rows.mapInArrow(_occurrences, "host string, token string, kind string, above string, " + ", ".join(f"{c} long" for c in numbers))
        .groupBy("host", "token", "kind", "above")
        .agg(*[F.sum(c).alias(c) for c in numbers])
    )
    is_text = F.col("kind") == "text"
    hosts = cut(rows.groupBy("host").agg(F.count("*").alias("host_pages")))
    if hosts.limit(MAX_HOSTS + 1).count() <= MAX_HOSTS:
        hosts = F.broadcast(hosts)
    counted = summed.where(~is_text | (F.col("n_pages") > 1)).join(hosts, "host")
    valid = (F.col("n_pages") >= support * F.col("host_pages")) & (~is_text | (F.col("n_pages") >= least_pages))
    vector = F.struct("n_pages", "n", "low", "high", is_text.alias("text")).alias("class")
    member = F.struct("token", "kind", "above", "chars", "direct", vector)
    # A slot and the returning texts directly in it meet, so that the slot knows how much of its text comes back.
    met = (
        counted.where(is_text | valid)
        .groupBy("host", "host_pages", F.when(is_text, F.col("above")).otherwise(F.col("token")).alias("place"))
        .agg(F.collect_list(F.when(valid, member)).alias("members"), F.sum(F.when(is_text, F.col("chars")).otherwise(0)).alias("again"))
    )
    each = met.select("host", "host_pages", "again", F.explode("members").alias("m"))
    fields = [*[F.col(f"m.{c}").alias(c) for c in ("token", "kind", "above", "chars", "direct")], F.when(F.col("m.kind") == "slot", F.col("again")).otherwise(0).alias("again")]
    return each.groupBy("host", "host_pages", F.col("m.class").alias("class")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("members"))


def _nest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for host, pages, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            slots = {m["token"]: Slot(m["above"], m["chars"], m["direct"], m["again"]) for m in members if m["kind"] == "slot"}
            texts = {m["token"]: (m["above"], m["chars"]) for m in members if m["kind"] == "text"}
            made = nest(slots, texts, pages)
            out.append((host, made.region, sorted(made.slots), sorted(made.texts)))
        columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
        types = (pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()))
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["host", "region", "slots", "texts"])


def templates(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(host, region, slots, texts): one row for each host; its size is bounded by the tokens of its average page over ``support``."""
    members = _classes(pages, support, LEAST_PAGES).select("host", "host_pages", F.filter("members", lambda m: m["kind"] != "tag").alias("members"))
    hosts = members.groupBy("host").agg(F.max("host_pages").alias("host_pages"), F.flatten(F.collect_list("members")).alias("members"))
    return hosts.mapInArrow(_nest_batches, "host string, region string, slots array<string>, texts array<string>")


def _template(found: dict | None) -> Template | None:
    return None if found is None or found["region"] is None else Template(found["region"], frozenset(found["slots"]), frozenset(found["texts"]))


def _extract_batches(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, Template | None] = {}
        for batch in batches:
            hosts, ids, urls, pages = (batch.column(k) for k in range(4))
            texts = []
            for k, (host, page) in enumerate(zip(hosts.to_pylist(), pages, strict=True)):
                if host not in made:
                    if len(made) > 1000:
                        made.clear()
                    made[host] = _template(sent.value.get(host) if sent is not None else {c: batch.column(c)[k].as_py() for c in ("region", "slots", "texts")})
                texts.append(extract(page.as_py() or "", made[host]))
            yield pa.record_batch([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract_pages(pages: DataFrame, support: float = SUPPORT, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(page_id, url, text, n_chars) of each page. Templates of up to ``max_broadcast`` slots and texts are sent to all
    executors; more are joined to the pages by host, where adaptive execution splits large hosts."""
    rows = _pages(pages)
    found = cut(templates(pages, support))
    shape = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    size = found.agg(F.coalesce(F.sum(1 + F.size("slots") + F.size("texts")), F.lit(0))).first()[0]
    if size <= max_broadcast:
        sent = pages.sparkSession.sparkContext.broadcast({r["host"]: r.asDict() for r in found.collect()})
        return rows.mapInArrow(_extract_batches(sent), shape)
    return rows.join(found, "host", "left").mapInArrow(_extract_batches(None), shape)


def op8_html_template(spark, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
