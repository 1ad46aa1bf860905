"""Main text of web pages by ratios of tag paths."""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Container, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# Fixed values of HTML: elements without content, elements whose content is no text of
# the page, elements that stand inside a line, and what an opening tag closes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = "script|style|noscript|template|iframe|object|svg|annotation|annotation-xml|title|textarea|select|canvas|audio|video"
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp"
    " small span strike strong sub sup time tt u var math semantics mi mn mo ms mtext mrow mfrac msup msub msqrt mroot".split()
)
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "article", "section", "main", "div", "body", "nav", "aside", "header", "footer", "form", "blockquote", "figure"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<silent>{SILENT})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=silent)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)

#: Elements, and words in class, id or role, that mark what surrounds an article.
ASIDE_TAGS = {"nav", "aside", "footer", "form", "menu", "dialog", "button", "head"}
ASIDE_NAMES = set(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies"
    " disclaimer footer form header login menu modal nav navbar navigation newsletter notice notices pagination"
    " popup promo related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe"
    " toolbar widget contentinfo complementary search dialog alert".split()
)
CONTENT_TAGS = {"article", "main"}
CONTENT_NAMES = set("article content entry main post story body".split())
#: Elements that are one paragraph or heading, never a container.
PARAGRAPHS = set("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption".split())
#: Headings are never surroundings by their names; many sites give them ids made of their words.
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
PUNCTUATION = re.compile(r"[.,;:!?。、，；：！？¿¡]")


class Block:
    """Text between block borders: the element it stands in, and its tag path's number."""

    __slots__ = ("at", "path", "parts", "linked")

    def __init__(self, at: int, path: int):
        self.at, self.path, self.parts, self.linked = at, path, [], 0


class Elements:
    """Elements in page order; number 0 is the page and parents come before children.

    Whatever asks about an element's holders is one pass over the parents, so time and
    memory follow the page's length however deep it nests.
    """

    def __init__(self):
        self.parent, self.tag, self.named, self.marked, self.aside = [-1], [""], [False], [False], [False]

    def add(self, parent: int, tag: str, named: bool, marked: bool, aside: bool) -> int:
        for column, value in zip((self.parent, self.tag, self.named, self.marked, self.aside), (parent, tag, named, marked, aside)):
            column.append(value)
        return len(self.parent) - 1

    def within(self, own: Container[int]) -> list[bool]:
        """Which elements are, or stand in, one of ``own``."""
        out: list[bool] = []
        for x, parent in enumerate(self.parent):
            out.append(x in own or parent >= 0 and out[parent])
        return out

    def numbers(self, flags: list[bool]) -> set[int]:
        return {x for x, flag in enumerate(flags) if flag}

    def nearest_named(self) -> list[int]:
        """The innermost element named as content that each is or stands in, or -1."""
        out: list[int] = []
        for x, parent in enumerate(self.parent):
            out.append(x if self.named[x] else out[parent] if parent >= 0 else -1)
        return out

    def totals(self, own: dict[int, int]) -> dict[int, int]:
        """Sums over each element and all it holds, the page itself left out."""
        sums = [own.get(x, 0) for x in range(len(self.parent))]
        for x in range(len(sums) - 1, 0, -1):
            sums[self.parent[x]] += sums[x]
        return {x: total for x, total in enumerate(sums) if x and total}


def class_words(rest: str) -> tuple[set[str], set[str], set[str]]:
    """Words inside class and role values; whole values; words of ids that consist of
    nothing but names of surroundings."""
    inside, whole, ids = set(), set(), set()
    for attribute, value in NAMES.findall(rest):
        for token in value.strip("\"'").lower().split():
            words = set(re.split(r"[^a-z]+", token)) - {""}
            if attribute.lower() != "id":
                inside |= words
                whole.add(token)
            elif words <= ASIDE_NAMES:
                ids |= words
            if token in CONTENT_NAMES:
                whole.add(token)
    return inside, whole, ids


def blocks_of(page: str) -> tuple[list[tuple[Block, str]], Elements]:
    """Blocks with text in page order, and the page's elements."""
    # Tag, number, inline, tag path; whether in surroundings, a link, a content tag, a content element.
    stack: list[tuple[str, int, bool, int, bool, bool, bool, bool]] = [("", 0, False, 0, False, False, False, False)]
    elements = Elements()
    paths: dict[tuple[int, str], int] = {}
    open_tags: Counter[str] = Counter()
    blocks: list[Block] = []
    current: Block | None = None
    at = 0

    def add(raw: str) -> None:
        nonlocal current
        if not raw:
            return
        if current is None:
            if raw.isspace():
                return
            current = Block(stack[-1][1], stack[-1][3])
            blocks.append(current)
        text = html.unescape(raw)
        current.parts.append(text)
        if stack[-1][5]:
            current.linked += len(text)

    def close(depth: int) -> None:
        open_tags.subtract(x[0] for x in stack[depth:])
        del stack[depth:]

    for token in TOKEN.finditer(page):
        add(page[at : token.start()])
        at = token.end()
        tag = (token["tag"] or "").lower()
        if not tag:
            continue
        if tag in VOID:
            if tag == "br" and current is not None:
                current.parts.append(" ")
            elif tag == "hr":
                current = None
            continue
        if token["close"]:
            if open_tags[tag]:
                depth = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag)
                if any(not x[2] for x in stack[depth:]):
                    current = None
                close(depth)
            continue
        inline = tag in INLINE
        if not inline:
            current = None
            ends = ENDED_BY.get(tag, {"p"})
            for depth in range(len(stack) - 1, 0, -1) if any(open_tags[x] for x in ends) else ():
                if stack[depth][0] in ends:
                    close(depth)
                    break
                if stack[depth][0] in SCOPES:
                    break
        _, parent, _, path, surrounded, linked, inside, held = stack[-1]
        names, whole, ids = class_words(token["rest"]) if token["rest"] else (set(), set(), set())
        aside = tag in ASIDE_TAGS or tag == "header" and not inside
        words = (whole if inline or tag in PARAGRAPHS else names) & ASIDE_NAMES
        if not (inline or tag in PARAGRAPHS or tag == "section" and len(ids) > 1):
            words |= ids
        if inside or held:
            words -= {"header"}
        marked = bool(words) and tag not in HEADINGS and tag not in ("body", "html", *CONTENT_TAGS - {"article"})
        named = not aside and not marked and (tag in CONTENT_TAGS or not inline and bool((names | whole) & CONTENT_NAMES))
        number = elements.add(parent, tag, named, marked, aside)
        if not inline:
            path = paths.setdefault((path, tag), len(paths) + 1)
        stack.append((tag, number, inline, path, surrounded or aside, linked or tag == "a", inside or tag in CONTENT_TAGS, held or named))
        open_tags[tag] += 1
    add(page[at:])
    texts = [(block, " ".join("".join(block.parts).split())) for block in blocks]
    return [(block, text) for block, text in texts if text], elements


def smoothed(values: list[float], radius: int = 1) -> list[float]:
    """Gaussian smoothing along the page."""
    weights = [math.exp(-((k / max(radius, 1)) ** 2) / 2) for k in range(-radius, radius + 1)]
    out = []
    for at in range(len(values)):
        near = [(weights[k + radius], values[at + k]) for k in range(-radius, radius + 1) if 0 <= at + k < len(values)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def chosen_paths(blocks: list[tuple[Block, str]]) -> set[int]:
    """Tag paths over the threshold of fused, smoothed ratios."""
    length, marks, count = defaultdict(float), defaultdict(float), defaultdict(int)
    for block, text in blocks:
        length[block.path] += max(0, len(text) - block.linked)
        marks[block.path] += len(PUNCTUATION.findall(text))
        count[block.path] += 1
    by_length = smoothed([length[block.path] / count[block.path] for block, _ in blocks])
    by_marks = smoothed([(1 + marks[block.path]) / count[block.path] for block, _ in blocks])
    fused = [a * b for a, b in zip(by_length, by_marks)]
    mean = sum(fused) / len(fused)
    threshold = min(mean, math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused)))
    return {block.path for (block, _), score in zip(blocks, fused) if score >= threshold}


def without_marked(blocks: list[tuple[Block, str]], elements: Elements) -> list[tuple[Block, str]]:
    """Blocks outside elements that names mark as surroundings.

    Names do not count on an element that holds the content element with most of the
    text, nor, where no content element is left with text, on one with more than half
    of the page's vote; if that leaves less than nine tenths of the vote, names do not
    count inside that content element or, without one, on the page. If nothing that votes is left, names do not count inside the
    content elements that have text left, or, without any, on the page.
    """
    marks = elements.numbers(elements.marked)
    if not marks:
        return blocks
    paths = chosen_paths(blocks)
    votes = elements.totals(summed(blocks, paths))
    total = sum(len(text) for block, text in blocks if block.path in paths)
    content = [x for x in votes if elements.named[x]]
    top = max(content, key=lambda x: (votes[x], -x)) if content else -1
    around, x = set(), elements.parent[top] if content else -1
    while x >= 0:
        around |= {x} & marks
        x = elements.parent[x]
    nearest = elements.nearest_named()

    def left(ignored: set[int]) -> list[tuple[Block, str]]:
        gone = elements.within(marks - ignored)
        return [(block, text) for block, text in blocks if not gone[block.at]]

    kept = left(around)
    if not any(nearest[block.at] >= 0 for block, _ in kept):
        kept = left(around | {x for x in marks if 2 * votes.get(x, 0) > total})
        if 10 * sum(len(text) for block, text in kept if block.path in paths) < 9 * total:
            if not content:
                return blocks
            outside, held = elements.within(marks), elements.within({top})
            return [(block, text) for block, text in blocks if held[block.at] or not outside[block.at]]
    if any(block.path in paths for block, _ in kept):
        return kept
    inner = {nearest[block.at] for block, _ in kept} - {-1}
    known, held = {id(block) for block, _ in kept}, elements.within(inner)
    return [(block, text) for block, text in blocks if id(block) in known or held[block.at]] if inner else blocks


def summed(blocks: list[tuple[Block, str]], paths: set[int]) -> dict[int, int]:
    """Text on the chosen paths by the element it stands in."""
    own: dict[int, int] = defaultdict(int)
    for block, text in blocks:
        own[block.at] += len(text) if block.path in paths else 0
    return own


def container(blocks: list[tuple[Block, str]], votes: dict[int, int], elements: Elements) -> int | None:
    """The element that is the article: of those with nearly all of the best vote the
    outermost ``article`` or ``main``, else the outermost named as content, else the
    deepest that is not a single paragraph."""
    tags, named = elements.tag, elements.named
    best = max(votes.values(), default=0)
    able = [x for x, vote in votes.items() if vote >= 0.95 * best and tags[x] not in INLINE]
    for kind in ([x for x in able if tags[x] in CONTENT_TAGS and named[x]], [x for x in able if named[x] and tags[x] not in PARAGRAPHS]):
        if kind:
            return min(kind)
    held = elements.totals(Counter(block.at for block, _ in blocks))
    wide = [x for x in able if tags[x] not in PARAGRAPHS]
    several = [x for x in wide if held[x] > 1 and tags[x] not in ("html", "body")]
    return max(several or wide, default=None)


def main_text(page: str) -> str:
    """The blocks of the page's content, in page order, joined by one space.

    Per root-to-leaf tag path, text without links and punctuation are divided by the
    number of blocks there; both ratios are smoothed along the page and fused by their
    product. Paths over the threshold (the standard deviation, or the mean if that is
    less) vote with their text for each element that holds them; elements named as
    content count double, and blocks in surroundings do not vote: those are told by
    their tag, or by names where the ratios do not speak against it. The text is all
    blocks outside surroundings that are on a chosen path or in the container, short
    ones and headings included.
    """
    blocks, elements = blocks_of(page)
    surrounded = elements.within(elements.numbers(elements.aside))
    blocks = without_marked([(block, text) for block, text in blocks if not surrounded[block.at]], elements)
    if not blocks:
        return ""
    chosen = chosen_paths(blocks)
    votes = elements.totals(summed(blocks, chosen))
    if not votes:
        return " ".join(text for _, text in blocks)
    votes = {x: vote * (2 if elements.named[x] else 1) for x, vote in votes.items()}
    article = container(blocks, votes, elements)
    held = elements.within({article})
    return " ".join(text for block, text in blocks if block.path in chosen or held[block.at])


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Columns ``id``, ``url``, ``text``; one row per page.

    Each page is parsed whole in its task; nothing is shuffled.

    Defined results: a null or empty page, or one without content, has the empty text;
    null ids and urls stay null; repeated rows and ties pass row by row; broken markup
    is read as far as it goes.
    """
    id_kind, url_kind = (pages.schema[x].dataType.simpleString() for x in (id_col, url_col))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(page) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"])

    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(extract, f"id {id_kind}, url {url_kind}, text string")
