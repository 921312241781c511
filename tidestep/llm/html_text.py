"""HTML extraction by composite text density.

Each page is parsed into a tree. For a node with C characters, T tags, LC characters and LT tags in links, and the body's
ratio LCb/Cb of link characters, the composite density is C / T * log(base ln(C/(C-LC) * LC + LCb/Cb * C + e)) of
(C/LC * T/LT): characters per tag, less where links prevail. Where that base is under e it is taken as e, as it would be 1
and the density without a bound in a tree without links; counts under 1 in a divisor are 1. The sum of the densities of a node's children tells
how much running text it holds: the node with the largest sum is the content, whatever its element. The least density on
its path to the body is the threshold that a further region must reach to count as content too.

A paragraph's region is the box that it stands in. A further region reaches the threshold and holds running text of its own: a tenth of the greatest density
sum, or as many characters as the content. Where the whole body is the densest, as on a page of a few lines, the box of its only title is taken if that holds a third of the characters.

Density alone would drop headings, short sections and what stands between regions. So the content is what the lowest element around the regions holds;
if they hold no <h1>, it grows to the nearest ancestor in which a heading stands before them. A block there counts unless it is more than half links;
in the body, which holds much else, only from that heading to the last region. Within the content a box (no paragraph, list item or cell) that holds links
is left out if its density is under THIN of what the content's children have on average: menus, adverts and readers' comments with links.

What stands in elements of the standard for menus, headers, footers, sidebars, drawings, media, controls and scripts, in
roles of these, or is hidden, is no part of the tree's text; a <header> in an <article>, <main> or <section> stays. Forms, and names (of a
class or id) made of words of the lists below alone, lower the score: the characters in such a subtree weigh DAMPED of their number, or
UNWANTED where the name tells an advert, a notice of cookies or comments. In and about the content, a damped subtree that doesn't hold it counts
only if its characters a tag, so weighed, still reach the content's. A page that is damped altogether is therefore judged like any other.

Pages are parsed one by one in a narrow pass: no shuffle, and memory of one page's tree at a time, in time linear in its length
(but for a logarithm), however deep its nesting.

Defined cases: null or empty html, or a page without content, gives an empty text; a very long page is parsed whole; tags
that don't close are closed by what follows, as browsers do, and end tags without a start are passed over; of nodes that tie the
first counts; repeated rows each give a row; an empty table gives no row; columns other than page_id, url and html aren't read.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidestep.llm.common import sliced

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_CLOSED = re.compile(r"""(?:^|[\s"'/]|[\s"'/][^\s=/"'>]+)/\Z""")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[^\W\d_]{2,}")
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)

#: Fixed values of the HTML standard: elements without content, of raw text, and of block display.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements of other vocabularies, those in them that hold HTML again, and the tags that end such an element.
FOREIGN = frozenset({"svg", "math"})
HOLDS_HTML = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
BREAKS_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var article section main header footer nav aside".split())
#: What an opening tag closes, and the elements that such closing doesn't leave.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "body": {"head"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "option": {"select"}, "body": set()}
_P_HOLDS = {"button", "table", "td", "th", "caption", "object", "body"}
#: Elements and roles that mark what is not the article.
NOISE = frozenset("head script style noscript template svg math iframe object embed canvas audio video nav footer aside button select input textarea dialog menu title xmp noembed noframes".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
SECTIONS = frozenset({"article", "main", "section"})
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Words of names of page furniture, of what is never wanted, and words that add nothing to such a name.
FURNITURE_WORDS = frozenset("banner menu nav navbar navigation breadcrumb breadcrumbs sidebar header footer masthead notice notices popup modal overlay signup login search social share sharing related recommended pagination pager toolbar widget widgets form forms".split())
UNWANTED_WORDS = frozenset("ad ads advert adverts advertisement advertisements adsense sponsor sponsored promo promotion cookie cookies consent gdpr newsletter subscribe comment comments commentlist disqus respond reply replies".split())
PLAIN_WORDS = frozenset("area bar block bottom box buttons container global google icons inner items left links list main outer page panel posts primary reader readers right secondary section site slot thread tools top unit user users wrap wrapper".split())
#: Blocks that group others; the share of the usual density of the content's children below which one that holds links is no content; and the share of the
#: greatest density sum that makes a further region.
BOXES = BLOCK - HEADINGS - frozenset("p pre li dt dd td th tr tbody thead tfoot caption figcaption summary blockquote address html body".split())
THIN, REGION = 0.01, 0.1
#: What a character in a damped subtree weighs.
DAMPED, UNWANTED = 0.05, 0.01


def name_weight(names: str, within_section: bool) -> float:
    """What characters weigh in an element of these classes and ids: damped if a name consists of listed words alone, more than plain ones."""
    weight = 1.0
    for name in _HUMP.sub("-", names).split():
        words = set(_WORD.findall(name.lower()))
        if words <= PLAIN_WORDS or not words <= FURNITURE_WORDS | UNWANTED_WORDS | PLAIN_WORDS:
            continue
        if words & UNWANTED_WORDS:
            weight = min(weight, UNWANTED)
        elif not (within_section and words <= PLAIN_WORDS | {"header"}):
            weight = min(weight, DAMPED)
    return weight


class Tree:
    """A page's nodes, in order: tag, parent, weight, and the stretch of `flow` that each covers; flow: texts, and None between blocks."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.begin, self.end, self.noise, self.weight = ["html"], [-1], [0], [0], [False], [1.0]
        self.flow: list[tuple[int, str] | None] = []
        self.foreign: list[int] = []  # the open <svg> and <math>
        self._stack = [0]
        self._open_at: dict[str, list[int]] = {"html": [0]}  # where in the stack each tag is open
        self._blocks = [0]  # where blocks are
        self._sections = 0
        at, n = 0, len(source)
        while at < n:
            m = _TOKEN.search(source, at)
            if not m:
                self._text(source[at:])
                break
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            tag, closing = name.lower(), m[1] or m[4]
            if closing:
                self._close(tag)
                continue
            attributes = m[3] or m[6] or ""
            within = self._foreign(tag)
            self._open(tag, attributes)
            if within or tag in FOREIGN:
                if _CLOSED.search(attributes) and tag not in VOID:
                    self._pop()
            elif tag in RAW:
                found = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
                self._pop()
                at = found.end() if found else n
        while self._stack:
            self._pop()
        self.last = list(range(len(self.tag)))  # of each node's subtree
        self.block = [0] * len(self.tag)  # the block that each node is, or stands in
        for i in range(len(self.tag) - 1, 0, -1):
            self.last[self.parent[i]] = max(self.last[self.parent[i]], self.last[i])
        for i in range(1, len(self.tag)):
            self.block[i] = i if self.tag[i] in BLOCK else self.block[self.parent[i]]

    def _text(self, text: str) -> None:
        if not self.noise[self._stack[-1]]:
            self.flow.append((self._stack[-1], html.unescape(text)))

    def _foreign(self, tag: str) -> bool:
        """Whether an opening tag stands directly in <svg> or <math>, which the tags of HTML end."""
        if not self.foreign:
            return False
        top = self._stack[-1]
        if self.tag[top] in HOLDS_HTML and top > self.foreign[-1]:
            return False
        if tag not in BREAKS_OUT:
            return True
        outer = self.foreign[-1]
        while self._stack[-1] >= outer:
            self._pop()
        return False

    def _pop(self) -> None:
        node = self._stack.pop()
        tag = self.tag[node]
        self._open_at[tag].pop()
        self._sections -= tag in SECTIONS
        if self.foreign and self.foreign[-1] == node:
            self.foreign.pop()
        if tag in BLOCK:
            self._blocks.pop()
            self.flow.append(None)
        self.end[node] = len(self.flow)

    def _open(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            if tag != "head":
                self._close_until({"head"}, {"body"})
            if tag not in ("html", "body"):
                self._close_until({"p"}, _P_HOLDS)
        if tag in CLOSES:
            self._close_until(CLOSES[tag], HOLDS[tag])
        node, parent = len(self.tag), self._stack[-1]
        noise, weight = self._judged(tag, attributes) if not self.noise[parent] else (True, 1.0)
        if tag in BLOCK:
            self.flow.append(None)
        self.tag.append(tag)
        self.parent.append(parent)
        self.begin.append(len(self.flow))
        self.end.append(len(self.flow))
        self.noise.append(noise)
        self.weight.append(weight)
        if tag == "br" and not noise:
            self.flow.append((node, " "))
        if tag not in VOID:
            self._open_at.setdefault(tag, []).append(len(self._stack))
            if tag in BLOCK:
                self._blocks.append(len(self._stack))
            self._sections += tag in SECTIONS
            self._stack.append(node)
            if tag in FOREIGN:
                self.foreign.append(node)

    def _close_until(self, tags: set[str], within: set[str]) -> None:
        """Closes the outermost open element of these tags that no element of `within` holds."""
        held = [own for t in tags if (own := self._open_at.get(t))]
        if not held:
            return
        bound = max((own[-1] for t in within if (own := self._open_at.get(t))), default=0)
        first = [own[k] for own in held if (k := bisect_right(own, bound)) < len(own)]
        if first:
            self._close_to(min(first))

    def _close_to(self, place: int) -> None:
        while len(self._stack) > place:
            self._pop()

    def _close(self, tag: str) -> None:
        own = self._open_at.get(tag)
        if own and own[-1] and (tag in BLOCK or own[-1] > self._blocks[-1]):  # an inline end tag doesn't close blocks
            self._close_to(own[-1])

    def _judged(self, tag: str, attributes: str) -> tuple[bool, float]:
        """Whether an element is no part of the article, and what characters in it weigh."""
        if tag in NOISE or tag == "header" and not self._sections:
            return True, 1.0
        weight = DAMPED if tag == "form" else 1.0
        if tag in ("html", "body") or not attributes:
            return False, weight
        found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
        if found.get("role", "").lower() in NOISE_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or _UNSEEN.search(found.get("style", "")):
            return True, 1.0
        return False, min(weight, name_weight(f"{found.get('class', '')} {found.get('id', '')}", self._sections > 0 or tag == "h1"))

    def densities(self) -> tuple[list[float], list[float]]:
        """Each node's composite density, and the sum of its children's; characters count by their weight."""
        n = len(self.tag)
        chars, tags, link_chars, link_tags = [0.0] * n, [0] * n, [0.0] * n, [0] * n
        weight, linked = self.weight[:], [False] * n
        for i in range(1, n):
            weight[i] = max(weight[i] * weight[self.parent[i]], 1e-9)
            linked[i] = self.tag[i] == "a" or linked[self.parent[i]]
        for item in self.flow:
            if item:
                size = len(item[1].strip()) * weight[item[0]]
                chars[item[0]] += size
                if linked[item[0]]:
                    link_chars[item[0]] += size
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            if not self.noise[i]:
                chars[p] += chars[i]
                link_chars[p] += link_chars[i]
                tags[p] += tags[i] + 1
                link_tags[p] += link_tags[i] + (self.tag[i] == "a")
        self.chars, self.link_chars, self.tags, self.linked = chars, link_chars, tags, linked
        ratio = link_chars[0] / max(chars[0], 1)
        density, sums = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            if chars[i] and not self.noise[i]:
                density[i] = composite_density(chars[i], tags[i], link_chars[i], link_tags[i], ratio)
            if i:
                sums[self.parent[i]] += density[i]
        return density, sums

    def _chosen(self) -> tuple[list[int], int, int, set[int]]:
        """(regions of content in order, the container around them, where in the flow it begins to count, the subtrees that don't count)."""
        density, sums = self.densities()
        n = len(self.tag)
        best = max(range(n), key=lambda i: (sums[i], density[i], -i))
        if not density[best]:
            return [], 0, 0, set()
        while best and self.tag[best] not in BOXES and self.tag[best] not in ("html", "body"):  # a paragraph stands in its box
            best = self.parent[best]
        if self.tag[best] in ("html", "body"):
            best = self._titled(best)
        around, threshold, at = {best}, density[best], best
        while at > 0:
            at = self.parent[at]
            around.add(at)
            threshold = min(threshold, density[at])
        a_tag = lambda i: self.chars[i] / max(self.tags[i], 1)  # noqa: E731; the density's logarithm grows with a node's size
        usual = sums[best] / max(1, sum(density[i] > 0 and self.parent[i] == best for i in range(best + 1, self.last[best] + 1)))
        out, i = set(), 0
        while i < n:
            named = self.weight[i] < 1 and a_tag(i) < a_tag(best)
            # a box that holds links and next to no running text for its tags
            thin = self.tag[i] in BOXES and self.link_chars[i] > 0 and density[i] < THIN * usual
            if i not in around and (named or thin):
                out.add(i)
                i = self.last[i]
            i += 1
        found, i = [], 0
        while i < n:
            if self.noise[i] or i in out:
                i = self.last[i]
            elif i == best or i not in around and self.tag[i] in BLOCK and density[i] >= threshold and (sums[i] >= REGION * sums[best] or self.chars[i] >= self.chars[best]) and 2 * self.link_chars[i] <= self.chars[i]:
                found.append(i)
                i = self.last[i]
            i += 1
        at = found[0]
        while at > 0 and not self.begin[at] <= self.begin[found[-1]] <= self.end[found[-1]] <= self.end[at]:
            at = self.parent[at]
        start, titled = self.begin[at], any(self.tag[i] == "h1" for r in found for i in range(r, self.last[r] + 1))
        up = at
        while up > 0 and not titled:
            below, up = up, self.parent[up]
            if self.tag[up] == "html":
                break
            heads = [i for i in self._children(up, below) if self.tag[i] in HEADINGS and not self.noise[i] and i not in out]
            if heads:
                at, start, titled = up, self.begin[heads[-1]] if self.tag[up] == "body" else self.begin[up], True
                for i in reversed(heads[:-1]):  # headings that stand right above it
                    if self.tag[up] == "body" and not any(item and item[1].strip() for item in self.flow[self.end[i] : start]):
                        start = self.begin[i]
        return found, at, start, out

    def _titled(self, best: int) -> int:
        """Where the whole body is the densest, as on a page of a few lines: the box of its only title, if that holds a third of the characters and more than the title."""
        titles = [i for i, t in enumerate(self.tag) if t == "h1" and not self.noise[i] and self.chars[i]]
        if len(titles) != 1 or self.tag[box := self.parent[titles[0]]] not in BOXES:
            return best
        return box if 3 * self.chars[box] >= self.chars[best] and self.chars[box] > self.chars[titles[0]] else best

    def _children(self, node: int, before: int) -> list[int]:
        """The children of a node that stand before one of them."""
        out, i = [], node + 1
        while i < before:
            out.append(i)
            i = self.last[i] + 1
        return out

    def content(self) -> list[int]:
        """The nodes whose subtrees are the page's content, in order."""
        return self._chosen()[0]

    def text(self) -> str:
        """The blocks of the content's subtrees, and those of the container that stand with them."""
        regions, container, start, out = self._chosen()
        if not regions:
            return ""
        inside, skipped = bytearray(len(self.flow) + 1), bytearray(len(self.flow) + 1)
        whole = any(self.tag[i] in ("html", "body") for i in regions)
        for i in regions:
            if self.tag[i] not in ("html", "body"):
                inside[self.begin[i] : self.end[i]] = b"\1" * (self.end[i] - self.begin[i])
        for i in out:
            skipped[self.begin[i] : self.end[i]] = b"\1" * (self.end[i] - self.begin[i])
        # an element of the page's own holds its content to its end; the body holds much else, so there it ends with the last region
        end = self.end[container] if whole or self.tag[container] not in ("html", "body") else self.end[regions[-1]]
        blocks: list[str] = []
        held: list[int] = []
        for k, item in enumerate([*self.flow, None]):
            if item:
                if not skipped[k]:
                    held.append(k)
            elif held:
                block = " ".join("".join(self.flow[j][1] for j in held).split())
                if block and (any(inside[j] for j in held) or start <= held[0] < end and not self._links(held)):
                    blocks.append(block)
                held = []
        return "\n".join(blocks)

    def _links(self, held: list[int]) -> bool:
        """Whether a block is more than half links."""
        return sum(len(self.flow[j][1].strip()) * (1 if self.linked[self.flow[j][0]] else -1) for j in held) > 0


def composite_density(chars: float, tags: int, link_chars: float, link_tags: int, ratio: float) -> float:
    """A node's composite density; ratio: the body's link characters over its characters."""
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + ratio * chars + math.e)
    of = chars / max(link_chars, 1) * max(tags, 1) / max(link_tags, 1)
    return chars / max(tags, 1) * math.log(max(of, 1.0 + 1e-9)) / math.log(max(base, math.e))


def main_text(source: str | None) -> str:
    return Tree(source).text() if source else ""


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    own = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
