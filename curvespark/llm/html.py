"""Main text of web pages by two passes over their blocks.

A page is cut into blocks of text. The first pass decides blocks by stop-word density, length and link density, wherever they stand; what the markup names
as page furniture is decided by its name. The second gives blocks that are left, most of them short, the label of the nearest decided neighbours: of
those in the same element if it has any, else of the same article (but for its furniture) or page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GOOD, BAD, OPEN = 1, 0, -1
#: Limits of the first pass: blocks under so many characters are short, so many of a good one's words are stop words, more of a bad one's characters are in links.
_LONG = 70
_STOPS = 0.12
_LINKS = 0.4

#: Stop words of the languages that pages are written in.
STOP_WORDS = frozenset(
    "the of and to in a is that it for was on are as with be by this from at or an not have has but they you we he she his her its their which will would can if there been more when who what all one so about out up into no "
    "le la les de des du un une et en que qui dans pour sur par pas est au aux avec ce il elle ne se plus sont ou son sa ses mais nous vous leur cette comme "
    "der die das und ist in den von zu mit sich des auf für nicht ein eine einer eines dem im es als auch an werden aus er hat dass sie nach wird bei noch wie um am sind über oder war nur "
    "el los las y a ante bajo con contra desde esa ese eso esta este esto hasta lo más me mi muy o para pero por porque se sin sobre su sus también te tu un una uno unos ya como del al".split()
)
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
_CONTAINERS = frozenset("article aside body div dialog dl fieldset figure footer form head header html li main menu nav ol section select table td tr ul details".split())
_FURNITURE = frozenset("nav header footer aside form menu dialog head select fieldset".split())
_PARTS = frozenset(("article", "main"))
#: Elements of which nothing is read.
_RAW = frozenset("script style noscript template svg math iframe object textarea button canvas title".split())
_WORDS_OF_NAMES = r"(?:^|[\s_-])(?:{})(?:$|[\s_-])"
#: Names of what is no article wherever it stands, and of what is none if it is mostly links.
_NAMES = re.compile(
    _WORDS_OF_NAMES.format(r"ads?|advert\w*|banner|sponsor\w*|promo|menu|nav|navbar|navigation|breadcrumbs?|side-?bar|foot(?:er)?|masthead|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|comments?|disqus|replies|login|signup|pagination|pager|notice|share|sharing|social"), re.I
)
_LINKED_NAMES = re.compile(_WORDS_OF_NAMES.format(r"widget|overlay|related|recommend\w*|trending|search|legal|copyright|disclaimer|top-?bar"), re.I)
_ROLES = re.compile(r"(?:navigation|banner|contentinfo|complementary|search|form|dialog|alert)$", re.I)
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_TAG_END = re.compile(r"[>\"']")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in _RAW}
_ATTRIBUTE = re.compile(r"([^\s=/\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)|'([^']*+)|([^\s\"']++)))?")
_WORD = re.compile(r"\w+")


@dataclass
class Block:
    """A run of text between block tags: its text, the characters in links, the article it stands in (0: none), whether it belongs to page furniture (1: if it is mostly links), the element that holds it."""

    text: str
    linked: int
    part: int
    furniture: int
    home: int = 0


def _furniture(name: str, rest: str, in_article: bool) -> int:
    """2: whatever it holds, 1: if that is mostly links, 0: no."""
    if name in _FURNITURE and not (name == "header" and in_article):
        return 2
    found = 0
    if rest and name not in ("body", "html", "article", "main"):
        for key, *values in _ATTRIBUTE.findall(rest):
            value, key = next((v for v in values if v), ""), key.lower()
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                return 2
            if key in ("class", "id") and _NAMES.search(value) or key == "role" and _ROLES.match(value):
                return 2
            if key in ("class", "id") and _LINKED_NAMES.search(value):
                found = 1
    return found


def _tag_end(page: str, at: int) -> int:
    """The place of the ``>`` that ends a tag, outside of quoted values; the page's end if there is none."""
    while m := _TAG_END.search(page, at):
        at = m.end()
        if m[0] == ">":
            return m.start()
        if page[max(0, m.start() - 8) : m.start()].rstrip().endswith("="):  # else the quote is part of a name
            if (at := page.find(m[0], at) + 1) == 0:
                break
    return len(page)


def _tags(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """Each tag with the text before it: text, name, whether it is an end tag, attributes. Every character is read a fixed number of times, however broken the page is."""
    start = at = 0
    while (lt := page.find("<", at)) >= 0:
        following = page[lt + 1 : lt + 2]
        if following == "!" or following == "?":
            text = page[start:lt]
            if page.startswith("<!--", lt):
                at = len(page) if (end := page.find("-->", lt + 2)) < 0 else end + 3
            else:
                at = len(page) if (end := page.find(">", lt)) < 0 else end + 1
            yield text, "", False, ""
            start = at
            continue
        closing = following == "/"
        m = _NAME.match(page, lt + 1 + closing)
        if m is None:
            at = lt + 1
            continue
        end = _tag_end(page, m.end())
        yield page[start:lt], m[0].lower(), closing, page[m.end() : end]
        start = at = min(end + 1, len(page))
        if not closing and m[0].lower() in _RAW and not page[m.end() : end].rstrip().endswith("/"):
            close = _RAW_END[m[0].lower()].search(page, at)
            start = at = len(page) if close is None else close.start()
    yield page[start:], "", False, ""


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, character references decoded, white space put together; blocks without text are left out."""
    out: list[Block] = []
    text: list[str] = []
    linked = links = furniture = weak = 0
    seen, parts = 0, [0]
    held, homes = 0, [0]
    stack: list[tuple[str, int]] = []
    standing: Counter[str] = Counter()

    def close() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.append(Block(joined, min(linked, len(joined)), parts[-1], 2 if furniture else 1 if weak else 0, homes[-1]))
            text.clear()
        linked = 0

    for raw, name, closing, rest in _tags(page):
        if raw:
            piece = html.unescape(raw) if "&" in raw else raw
            text.append(piece)
            if links:
                linked += len(" ".join(piece.split()))
        if name == "a":
            links = 0 if closing else 1
        elif name == "br":
            text.append(" ")
        if name not in _BLOCKS:
            continue
        close()
        if closing:
            while standing[name]:
                n, f = stack.pop()
                standing[n] -= 1
                furniture -= f == 2
                weak -= f == 1
                if n in _PARTS:
                    parts.pop()
                if n in _CONTAINERS:
                    homes.pop()
                if n == name:
                    break
            continue
        holds = name in _CONTAINERS and not rest.rstrip().endswith("/")
        kind = _furniture(name, rest, len(parts) > 1) if holds or rest else 0
        if holds or kind:
            if holds and name in ("nav", "article", "main", "footer"):
                links = 0
            if name in _PARTS and holds:
                seen += 1
                parts.append(seen)
            if holds:
                held += 1
                homes.append(held)
            stack.append((name, kind))
            standing[name] += 1
            furniture += kind == 2
            weak += kind == 1
    close()
    return out


def first_pass(block: Block) -> int:
    """Bad: named furniture, outside of articles what is mostly links and copyright lines, inside links without stop words; good: long with stop words; open: short ones, links in words of an article, and long ones with too few stop words to tell."""
    density = block.linked / len(block.text)
    if block.furniture == 2 or block.furniture == 1 and density > _LINKS:
        return BAD
    words = _WORD.findall(block.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if density > _LINKS:
        return OPEN if block.part and stops >= _STOPS else BAD
    if len(block.text) < _LONG:
        return BAD if "©" in block.text and not block.part else OPEN
    if stops >= _STOPS:
        return GOOD
    return OPEN


def _nearest(places: list[int], labels: list[int]) -> dict[int, tuple[int, int, int, int]]:
    """Of each open block among ``places``, in their order: how far the last decided one before it is and its label, and the same of the next one after it; unknown ones are ``len(labels)`` away."""
    out: dict[int, tuple[int, int, int, int]] = {}
    near, label = len(labels), OPEN
    for k in places:
        near, label = (0, labels[k]) if labels[k] != OPEN else (min(near + 1, len(labels)), label)
        out[k] = (near, label, 0, OPEN)
    near, label = len(labels), OPEN
    for k in reversed(places):
        near, label = (0, labels[k]) if labels[k] != OPEN else (min(near + 1, len(labels)), label)
        out[k] = (*out[k][:2], near, label)
    return out


def second_pass(found: list[Block], labels: list[int]) -> list[int]:
    """Open blocks take the label of the nearest decided neighbour in the element that holds them, if it has one, else in their article, outside of articles in the page; an article's named furniture is nobody's neighbour.

    Between a good and a bad one equally near, and without any, they are good in an article and bad outside.
    """
    homes: dict[int, list[int]] = {}
    parts: dict[int, list[int]] = {}
    for k, block in enumerate(found):
        named = block.furniture == 2 or block.furniture == 1 and labels[k] == BAD
        if not (named and block.part):
            homes.setdefault(block.home, []).append(k)
            parts.setdefault(block.part, []).append(k)
    page = _nearest(list(range(len(found))), labels)
    for part, places in parts.items():
        if part:
            page |= _nearest(places, labels)
    own: dict[int, tuple[int, int, int, int]] = {}
    for places in homes.values():
        own |= _nearest(places, labels)
    out = list(labels)
    for k, block in enumerate(found):
        if labels[k] != OPEN:
            continue
        inside = own[k][1] != OPEN or own[k][3] != OPEN
        near, before, far, after = own[k] if inside else page[k]
        if before == OPEN or after == OPEN:
            label = before if after == OPEN else after
        elif near != far:
            label = before if near < far else after
        else:
            label = before if before == after else OPEN
        out[k] = label if label != OPEN else GOOD if block.part else BAD
    return out


def main_text(page: str | None) -> str:
    """The blocks that both passes call good, two line ends between them; null and empty pages have none."""
    found = blocks(page or "")
    labels = second_pass(found, [first_pass(b) for b in found])
    return "\n\n".join(b.text for b, label in zip(found, labels, strict=True) if label == GOOD)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names[:-1], "text", "n_chars"])


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages``' columns without the HTML, and ``text`` and ``n_chars`` (code points) of its main text; columns of these names are replaced.

    Null and empty pages have an empty text. Each row is read by itself, so repeated rows and ids don't matter. Unclosed tags end with what holds
    them, unclosed comments and scripts with the page.
    """
    kept = pages.select(*(c for c in pages.columns if c not in (html_col, "text", "n_chars")), F.col(html_col).cast("string").alias("__html"))
    schema = kept.drop("__html").schema.add("text", "string").add("n_chars", "long")
    return kept.mapInArrow(_extract, schema)
