"""Main text of web pages by consensus of a host's pages.

Each page scores its containers and climbs from the best one as long as that adds text; Spark sums the votes for
generalised tag-class paths per host; each page is then extracted again with its host's winning path, or with its own
best one where the winner does not occur or has no text. Parsing, scoring and extraction take time and memory in
proportion to the page, whatever its markup: every character is scanned a bounded number of times, and a container
holds its own part of its path only.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, extended, in_arrow
from .urlrules import url_host

#: Estimated bytes up to which the table of winning paths is broadcast.
BROADCAST_BYTES = 32 << 20
#: What a container keeps of its children's score; the favour for article elements.
KEPT, ARTICLE = 0.95, 1.25

TAG_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*+")
#: The end of a tag, or a quotation mark that opens a value; attributes with their values (quoted or not).
TAG_END = re.compile(r">|=\s*+([\"'])")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>]*+)))?|.""", re.S)
LONG_NUMBER = re.compile(r"&#\d{9,}")
#: Elements whose content is no markup, up to their end tag.
RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style", "title", "textarea", "iframe", "noscript", "xmp")}
#: Elements that hold blocks and may be the article; elements that end a block; elements closed by another of their kind.
CONTAINERS = frozenset("body main article section div td center blockquote".split())
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr th pre hr figure figcaption address details summary "
    "header footer nav aside form fieldset menu dialog html head caption svg template select button object".split()
)
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
CLOSES_P = BLOCKS - {"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "html", "head", "body", "svg", "template", "select", "button", "object"}
VOID = frozenset(("hr",))
PARTS = frozenset("nav footer aside main article".split())
#: Elements that are never part of an article.
NOT_ARTICLE = frozenset("nav footer aside form menu dialog head fieldset svg template select button object".split())
#: Words, in class, id or role, for what is hardly ever part of an article; for what may be one, so other evidence is needed.
SURE = frozenset(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer login masthead menu modal nav navbar navigation newsletter pagination popup promo promoted "
    "share sharing sidebar signup social sponsor sponsored subscribe toolbar widget contentinfo complementary respond replies".split()
)
UNSURE = frozenset("header related search form notice notices discussion banner dialog promotion".split())
#: Words that say nothing by themselves (site-footer, comments-area, commentlist); words that make a name say what the block has or lacks (has-comments).
NEUTRAL = frozenset("site page main global area list section block box bar wrap wrapper container inner left right top bottom slot unit buttons icons links".split())
OTHERWISE = frozenset("has with no without is hide show before after".split())
#: Roles that say what a class of the same name only may say.
ROLES = {"banner": "masthead", "dialog": "modal", "alertdialog": "modal"}
EXEMPT = frozenset("html body main".split())
#: What readers write, which may well be longer than the article.
READERS = frozenset("comment comments disqus replies respond".split())


class Node:
    """A container, or another block that may be no part of an article. name: its own part of the path."""

    __slots__ = ("tag", "name", "dropped", "marks", "hints", "up", "own", "links", "kids", "texts", "blocks", "place")

    def __init__(self, tag: str, name: str, dropped: bool, marks: frozenset[str] = frozenset(), hints: frozenset[str] = frozenset(), up: Node | None = None, place: int = 0):
        self.tag, self.name, self.dropped, self.marks, self.hints, self.up, self.place = tag, name, dropped, marks, hints, up, place
        self.own, self.links, self.blocks, self.kids, self.texts = 0, 0, 0, [], []

    def path(self) -> str:
        parts, at = [], self
        while at is not None:
            parts.append(at.name)
            at = at.up
        return "".join(reversed(parts))


def stem(word: str) -> str:
    """A word that is a neutral one joined to one of SURE or UNSURE (commentlist, pagefooter) as the latter."""
    for i in range(2, len(word) - 1):
        for part, rest in ((word[:i], word[i:]), (word[i:], word[:i])):
            if rest in NEUTRAL and (part in SURE or part in UNSURE):
                return part
    return word


@lru_cache(1 << 14)
def said(name: str) -> tuple[frozenset[str], frozenset[str]]:
    """(marks, hints) of a name: the words of SURE and UNSURE that it wholly consists of; or one that it starts or ends with (ad-slot, post-comments)."""
    words = [w if w in SURE or w in UNSURE or w in NEUTRAL else stem(w) for w in re.split(r"[^a-z]+", name) if w]
    core = [w for w in words if w not in NEUTRAL]
    known = frozenset(core) & (SURE | UNSURE)
    if len(known) == len(set(core)):
        return known, frozenset()
    return frozenset(), frozenset() if OTHERWISE & set(core) else known & {core[0], core[-1]}


def names(attributes: str) -> tuple[str, frozenset[str], frozenset[str]]:
    """The class generalised (digits away, parts sorted), and marks and hints of the names in class, id and role; see said()."""
    general, marks, hints = "", frozenset(), frozenset()
    for m in ATTRIBUTE.finditer(attributes):
        kind = m[1].lower() if m[1] else ""
        if kind not in ("class", "id", "role"):
            continue
        value = (m[2] or m[3] or m[4] or "").lower()
        for name in value.split():
            whole, part = said(ROLES.get(name, name) if kind == "role" else name)
            marks, hints = marks | whole, hints | part
        if kind == "class" and not general:
            general = ".".join(sorted({x.replace("/", "") for x in re.sub(r"\d+", "", value).split()} - {""}))
    return general, marks, hints


def tags(page: str) -> Iterator[tuple[int, int, str, str]]:
    """start, end, name (with / for end tags, empty for comments and the like) and attributes of each piece of markup.

    Raw elements are one piece with their content. Where quotes do not close, tags end at the next > from there on; a tag
    that never ends takes the rest of the page.
    """
    at, size, quoting, unclosed = 0, len(page), True, set()
    last = page.rfind(">")
    while 0 <= (start := page.find("<", at)):
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            yield start, at, "", ""
            continue
        m = TAG_NAME.match(page, start + 1)
        if not m and page[start + 1 : start + 2] not in ("!", "?", "/"):
            at = start + 1
            continue
        if start > last:
            yield start, size, "", ""
            return
        end, inner = -1, m.end() if m else start + 1
        pos = inner
        while m and quoting:
            e = TAG_END.search(page, pos)
            if not e or not e[1]:
                end = e.end() if e else -1
                break
            close = -1 if e[1] in unclosed else page.find(e[1], e.end())
            if close < 0:
                unclosed.add(e[1])
            pos = e.end() if close < 0 else close + 1
        if end < 0:
            quoting = quoting and not m
            end = page.find(">", inner) + 1
        name = m[0].lower() if m else ""
        at = end
        if name in RAW and name not in unclosed:
            close = RAW[name].search(page, end)
            if close:
                at = page.find(">", close.end()) + 1 or size
            elif name in ("script", "style"):
                at = size
            else:
                unclosed.add(name)
            yield start, at, "", ""
            continue
        yield start, at, name, page[inner : end - 1] if name else ""


def decoded(text: str) -> str:
    """Character references resolved, white space as one space, trimmed. Numbers too long for a code point give the replacement character."""
    if "&" in text:
        text = entities.unescape(LONG_NUMBER.sub("&#1114112", text))
    return " ".join(text.split())


def parse(page: str) -> list[Node]:
    """The page's containers in page order, each with its own blocks of text; the first is the page's root. See drop_marked() for what is dropped."""
    root = Node("", "", False)
    nodes, stack, opened = [root], [("", root, False)], Counter()  # stack: (tag, container, dropped)
    parts: list[str] = []
    linked = at = count = 0
    in_link = False

    def flush() -> None:
        nonlocal linked, count
        if parts:
            _, box, dropped = stack[-1]
            text = "" if dropped else decoded("".join(parts))
            if text:
                box.texts.append((count, text))
                count += 1
                box.own += len(text)
                box.links += min(linked, len(text))
                box.blocks += 1
            parts.clear()
            linked = 0

    for start, end, tag, attributes in tags(page):
        if start > at:
            parts.append(page[at:start])
            if in_link:
                linked += start - at
        at = end
        if not tag:
            continue
        closing = tag[0] == "/"
        tag = tag[1:] if closing else tag
        if tag not in BLOCKS:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                in_link = not closing
            continue
        flush()
        in_link = False
        if closing:
            while opened[tag]:
                last = stack.pop()[0]
                opened[last] -= 1
                if last == tag:
                    break
            continue
        while len(stack) > 1 and (stack[-1][0] in SELF_CLOSING.get(tag, ()) or stack[-1][0] == "p" and tag in CLOSES_P):
            opened[stack.pop()[0]] -= 1
        if tag in VOID:
            continue
        _, box, dropped = stack[-1]
        general, marks, hints = names(attributes) if attributes else ("", frozenset(), frozenset())
        if tag in EXEMPT:
            marks = hints = frozenset()
        elif tag == "header":
            marks |= {"header"}
        dropped = dropped or tag in NOT_ARTICLE
        if tag in CONTAINERS or (marks or hints) and not dropped or tag in PARTS:
            box.kids.append(node := Node(tag, f"/{tag}{'.' if general else ''}{general}", dropped, marks, hints, box, len(nodes)))
            nodes.append(node)
            box = node
        stack.append((tag, box, dropped))
        opened[tag] += 1
    parts.append(page[at:])
    flush()
    drop_marked(nodes)
    return nodes


def totals(nodes: list[Node], value) -> list[float]:
    """The sum of value over each container that is not dropped and all such containers inside it, by its place."""
    out = [0 if n.dropped else value(n) for n in nodes]
    for n in reversed(nodes):  # children come after their parents
        if n.up is not None and not n.dropped:
            out[n.up.place] += out[n.place]
    return out


def drop_marked(nodes: list[Node]) -> None:
    """Settle which of the named blocks are dropped; what is inside a dropped block is dropped, too.

    Names weigh, and shares of the page decide; no length does, so a page that is longer as a whole loses the same blocks.
    A block that a sure word names goes, however long it is, as long as there is other text without such a name. A name
    that only starts or ends with a sure word goes, too, but not where the block holds an article or main element or
    most of the page's text without links; what readers write goes from there as well. Unsure names need evidence from
    place or content: a header outside an article element belongs to the page if it is in the body itself or beside
    PARTS of a page, holds navigation, or has less than half of the text around it; a notice or search has two blocks at
    most and less than half of the text; a discussion has several alike containers; anything else is mostly links.
    Nothing is dropped if no text would be left.
    """
    if not any((n.marks or n.hints) and not n.dropped for n in nodes):
        return
    before = [n.dropped for n in nodes]
    size, links, blocks = totals(nodes, lambda n: n.own), totals(nodes, lambda n: n.links), totals(nodes, lambda n: n.blocks)
    plain = [a - b for a, b in zip(size, links)]
    holds = totals(nodes, lambda n: n.tag in ("article", "main"))
    marked, article, only = [False] * len(nodes), [False] * len(nodes), None
    enclosed, parted = [False] * len(nodes), [False] * len(nodes)  # within an article element; with a part of the page as child

    def sure(n: Node) -> bool:
        return bool(n.marks & SURE or n.hints & READERS or n.hints & SURE and not holds[n.place] and 2 * plain[n.place] <= plain[0])

    for n in nodes[1:]:
        marked[n.place] = marked[n.up.place] or sure(n) or bool(n.marks - {"header"})
        enclosed[n.place] = enclosed[n.up.place] or n.up.tag == "article"
        parted[n.up.place] = parted[n.up.place] or n.tag in PARTS
    clear = totals(nodes, lambda n: 0 if marked[n.place] else n.own - n.links)
    articles = [n for n in nodes if n.tag == "article" and clear[n.place]]
    if len(articles) == 1:
        only = articles[0]
        for n in nodes[only.place :]:
            article[n.place] = n is only or n.up is not None and article[n.up.place]

    def evidence(n: Node) -> bool:
        i, words = n.place, n.marks | n.hints
        if sure(n) or 2 * links[i] > size[i]:
            return True
        if not n.marks:
            return False
        if "header" in words:
            beside = parted[n.up.place] or 2 * plain[n.up.place] < plain[0]
            return not enclosed[i] and (n.up.tag in ("", "body") or beside or any(k.tag == "nav" for k in n.kids))
        if "discussion" in words:
            return max(Counter(k.name for k in n.kids if size[k.place]).values(), default=0) > 1
        return bool(words & {"notice", "notices", "search"}) and blocks[i] <= 2 and 2 * plain[i] < plain[0]

    for n in nodes[1:]:
        if (n.marks or n.hints) and not n.dropped and evidence(n):
            alone = 2 * plain[n.place] > plain[0] and not (sure(n) and clear[0])
            n.dropped = not alone or only is not None and not article[n.place]
        n.dropped = n.dropped or n.up.dropped
    if not any(n.own for n in nodes if not n.dropped):
        for n, was in zip(nodes, before):
            n.dropped = was


def scores(nodes: list[Node]) -> dict[int, float]:
    """Of each container by its place: its own text without links, and most of its children's score."""
    out: dict[int, float] = {}
    for n in reversed(nodes):  # children come after their parents
        if not n.dropped:
            out[n.place] = (n.own - n.links + KEPT * sum(out.get(k.place, 0) for k in n.kids)) * (ARTICLE if n.tag == "article" else 1)
    return out


def climb(nodes: list[Node], best: Node) -> Node:
    """The ancestor of the best container that has the whole article: headlines and leads may stand outside the best one.

    It is reached level by level while the text that a level adds is not mostly links. A body, or what is around an
    article element, is reached only if it has text of its own: other containers in it are other parts of the page.
    """
    size, links = totals(nodes, lambda n: n.own), totals(nodes, lambda n: n.links)
    at, up, closed = best, best.up, best.tag == "article"
    while up is not None:
        more = size[up.place] - size[at.place]
        closed = closed or up.tag in ("body", "")
        if 2 * (links[up.place] - links[at.place]) > more or more and closed and not up.own:
            break
        if more:
            at = up
        closed = closed or up.tag == "article"
        up = up.up
    return at


def best_container(nodes: list[Node]) -> Node | None:
    """The page's best container; null for a page without text. Among equals the first in the page."""
    rated = [(-s, i) for i, s in scores(nodes).items() if s > 0]
    return climb(nodes, nodes[min(rated)[1]]) if rated else None


def best_path(page: str | None) -> str | None:
    """The path of the page's best container; null for a page without text."""
    best = best_container(parse(page or ""))
    return best.path() if best else None


def at_path(nodes: list[Node], path: str) -> list[Node]:
    """The containers with this path that are not dropped. Each node is compared with one part of the path only."""
    parts = [f"/{x}" for x in path.split("/")[1:]]
    depth = [0] + [-1] * (len(nodes) - 1)  # how many parts agree, -1 from the first that does not
    for n in nodes[1:]:
        d = depth[n.up.place]
        if 0 <= d < len(parts) and parts[d] == n.name:
            depth[n.place] = d + 1
    return [n for n in nodes if depth[n.place] == len(parts) and not n.dropped]


def text_of(chosen: list[Node]) -> str:
    """The text of containers and all that is in them and not dropped; blocks joined by line feeds."""
    found: dict[int, str] = {}
    while chosen:
        n = chosen.pop()
        found.update(n.texts)
        chosen += [k for k in n.kids if not k.dropped]
    return "\n".join(found[i] for i in sorted(found))


def extract(page: str | None, path: str | None) -> str:
    """The text of the containers with this path, or of the page's best one if they have none; blocks joined by line feeds."""
    nodes = parse(page or "")
    text = text_of(at_path(nodes, path)) if path is not None else ""
    return text or text_of([best_container(nodes) or nodes[0]])


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path, votes: the path that most pages of a host find best; ties go to the greater path. Hot hosts are summed before the shuffle."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = pa.array([best_path(page.as_py()) for page in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), paths], names=["host", "path"])

    cast = in_arrow(pages.select(url_host(F.col("url")).alias("host"), "html"), vote, "host string, path string").where("path is not null")
    sums = cast.groupBy("host", "path").agg(F.count("*").alias("votes"))
    return sums.groupBy("host").agg(F.max(F.struct("votes", "path")).alias("won")).select("host", "won.path", "won.votes")


def main_text(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars, path (the host's winner).

    Null html, and pages without text, give an empty text. Null urls vote together as one host with an empty name.
    Repeated rows are extracted one by one. The table of winners is broadcast if it is small, else pages are joined with it.
    """
    won = cut(host_paths(pages).select("host", "path"), "paths")
    size = won.agg(F.sum(F.length("host") + F.length("path") + 48)).first()[0] or 0
    rows = pages.select("page_id", "url", "html", url_host(F.col("url")).alias("host"))
    rows = rows.join(F.broadcast(won) if size <= BROADCAST_BYTES else won, "host", "left").select("page_id", "url", "path", "html")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                texts = [extract(page.as_py(), path.as_py()) for page, path in zip(part.column(3), part.column(2))]
                cols = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), part.column(2)]
                yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars", "path"])

    return in_arrow(rows, read, extended(pages, ["page_id", "url"], "text string, n_chars long, path string"))
