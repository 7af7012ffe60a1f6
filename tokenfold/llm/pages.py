"""Main text of web pages by two passes of block rules."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A block with a larger share of its characters in links is no text; one shorter than SHORT characters is ambiguous.
MOST_LINKS, SHORT, LONG = 0.5, 70, 200
#: Shares of stop words from which a block may be text, and from which a long one is.
STOP_LOW, STOP_HIGH = 0.1, 0.15

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset("""
the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all
der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei
de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec mais ou comme nous
el que y a los del las por con no su para al lo como más o pero sus le ha me si sin sobre este ya entre cuando
""".split())

# Element names of the markup standard.
BLOCKS = frozenset("""address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure
footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table
tbody td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
IN_HEAD = RAW | {"head", "meta", "link", "base", "noscript", "template", "html"}
NO_TEXT = frozenset("head noscript template svg select button datalist object audio video canvas map".split())
#: Elements that a new one of the same group ends, and the elements beyond which it doesn't reach.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

# Elements, roles and words of class names and ids that name the parts around an article.
BOILERPLATE_ELEMENTS = frozenset("nav footer aside form fieldset menu dialog search legend".split())
BOILERPLATE_ROLES = frozenset("navigation menu menubar toolbar banner contentinfo complementary search form alert alertdialog dialog".split())
BOILERPLATE_WORDS = frozenset("""nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager toolbar skiplink
footer sidebar aside widget widgets notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription toast paywall
ad ads adv advert adverts advertisement advertising advertorial adsense adsbygoogle sponsor sponsored sponsors promo promotion promoted banner
form comment comments commentlist respond reply replies disqus discussion share sharing social related recommended recommendations trending""".split())
ADVERT_WORDS = frozenset("ad ads advert adverts advertisement adsbygoogle sponsored promo promoted".split())
HEADER_WORDS = frozenset("header masthead topbar".split())
CONTENT_WORDS = frozenset("article content main post entry story body text".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']\S*)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

UNKNOWN, CONTENT, BOILERPLATE, ARTICLE_HEADER = range(4)


@dataclass(slots=True)
class Block:
    """One block's text with what the rules look at; ``region`` numbers the article or main element around it (0: none)."""

    text: str
    kind: int
    region: int
    linked: float
    heading: bool
    label: bool | None = None


@lru_cache(4096)
def _mark(name: str, attributes: str) -> tuple[int, bool]:
    """(kind of an element by itself, whether it is an article or main element)."""
    values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
    role = values.get("role", "").lower()
    named = re.split(r"\s+", f"{values.get('class', '')} {values.get('id', '')}")
    words = [[w.lower() for w in _WORD.findall(n)] for n in named]
    words = {w for own in words if own and own[0] not in ("has", "with", "no", "without") for w in own}
    if name not in BLOCKS and name not in NO_TEXT:
        return (BOILERPLATE if words & ADVERT_WORDS else UNKNOWN), False
    hidden = "hidden" in values or values.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", values.get("style", ""), re.I)
    strong = name in ("article", "main") or role in ("main", "article") or "articlebody" in values.get("itemprop", "").lower()
    if hidden or name in NO_TEXT or name in BOILERPLATE_ELEMENTS or role in BOILERPLATE_ROLES or words & BOILERPLATE_WORDS:
        return BOILERPLATE, False
    if name == "header" or words & HEADER_WORDS:
        return ARTICLE_HEADER, False
    return (CONTENT if strong or words & CONTENT_WORDS else UNKNOWN), strong


def blocks(html: str) -> list[Block]:
    """The blocks of a page in order: texts between tags that start or end a block, references decoded, white space collapsed.

    Scripts, styles, comments and other elements without readable text are left out here. An element's kind holds inside it, what
    surrounds it never turns boilerplate into text, but an article or main element inside a form or a header counts by itself.
    """
    out: list[Block] = []
    stack: list[tuple[str, int, int, bool, int]] = []  # (name, kind, region, in a link, place of the block element around it)
    open_: dict[str, int] = {}
    parts: list[str] = []
    linked, breaks, regions, block_at, at, n = 0, 0, 0, -1, 0, len(html)
    kind, region, link = UNKNOWN, 0, False

    def flush() -> None:
        nonlocal linked, breaks
        breaks = 0
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                heading = any(open_.get(f"h{k}") for k in range(1, 7))
                raw = sum(len(p) - p.count(" ") for p in parts)
                out.append(Block(text, kind, region, linked / raw if raw else 0.0, heading))
            parts.clear()
        linked = 0

    def close(upto: int) -> None:
        nonlocal kind, region, link, block_at
        while len(stack) > upto:
            name, _, _, _, block_at = stack.pop()
            open_[name] -= 1
        _, kind, region, link, _ = stack[-1] if stack else ("", UNKNOWN, 0, False, -1)

    def text(chunk: str) -> None:
        nonlocal linked, breaks
        if chunk:
            parts.append(chunk)
            if not chunk.isspace():
                breaks = 0
            if link:
                linked += len(chunk) - chunk.count(" ")

    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            text(html[at:])
            break
        if m.start() > at:
            text(html[at:m.start()])
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in BLOCKS or name == "br":
                flush()
            if open_.get(name):
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                if name not in BLOCKS and stack[k][1] != (stack[k - 1][1] if k else UNKNOWN):
                    flush()
                close(k)
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(html, at)
            at = end.start() if end else n
            tail = _TOKEN.match(html, at)
            at = tail.end() if tail else n
            if name in BLOCKS:
                flush()
            continue
        if name == "br":
            breaks += 1
            if breaks > 1:
                flush()
            else:
                parts.append(" ")
            continue
        if name == "hr":
            flush()
        if name in VOID or name in ("html", "body"):
            if name == "body":
                flush()
                close(0)
            continue
        if open_.get("head") and name not in IN_HEAD:
            close(0)
        if name in BLOCKS:
            flush()
            if open_.get("p") and block_at >= 0 and stack[block_at][0] == "p":
                close(block_at)
            ends, beyond = ENDS.get(name, ((), ()))
            if block_at >= 0 and any(open_.get(x) for x in ends):
                k = block_at
                while k >= 0 and stack[k][0] not in ends and stack[k][0] not in beyond:
                    k -= 1
                while k > 0 and stack[k][0] in ends and stack[k - 1][0] in ends:
                    k -= 1
                if k >= 0 and stack[k][0] in ends:
                    close(k)
        own, strong = (UNKNOWN, False) if name == "a" else _mark(name, m[3])
        inside = kind
        if own == ARTICLE_HEADER:
            own = ARTICLE_HEADER if kind == CONTENT else BOILERPLATE if kind == UNKNOWN else kind
        if own == BOILERPLATE or (own != UNKNOWN and kind != BOILERPLATE) or (strong and kind == BOILERPLATE and open_.get("form") and _only_form(stack)):
            inside = own
        if inside != kind and name not in BLOCKS:
            flush()
        if strong and inside == CONTENT and not region:
            regions += 1
            region = regions
        stack.append((name, inside, region, link or name == "a", block_at))
        open_[name] = open_.get(name, 0) + 1
        kind, link = inside, link or name == "a"
        if name in BLOCKS or name in NO_TEXT:
            block_at = len(stack) - 1
    flush()
    return out


def _only_form(stack: list[tuple[str, int, int, bool, int]]) -> bool:
    """Whether a form alone makes what lies inside boilerplate: some pages stand in one form as a whole."""
    first = next(k for k, x in enumerate(stack) if x[1] == BOILERPLATE)
    return stack[first][0] == "form"


def first_pass(page: list[Block]) -> None:
    """Label what decides itself: True for text, False for boilerplate, None where a block is too short or only fairly dense."""
    main = any(b.region and b.kind in (CONTENT, ARTICLE_HEADER) for b in page)
    for b in page:
        if b.kind == BOILERPLATE or (main and not b.region):
            b.label = False
        elif b.kind == ARTICLE_HEADER:
            b.label = None if b.heading else False
        elif b.linked > MOST_LINKS and not b.heading:
            b.label = False
        elif b.kind == UNKNOWN and len(b.text) < LONG and b.text.lower().startswith(("©", "(c) ", "copyright")):
            b.label = False
        elif b.kind == CONTENT:
            b.label = None if len(b.text) < SHORT else True
        elif len(b.text) < SHORT:
            b.label = False if b.linked and not b.heading else None
        else:
            words = b.text.lower().split()
            share = sum(w.strip(".,;:!?\"'()«»¿¡") in STOP_WORDS for w in words) / len(words)
            b.label = True if share >= STOP_HIGH and len(b.text) >= LONG else False if share < STOP_LOW else None


def second_pass(page: list[Block]) -> None:
    """Ambiguous blocks take the label of the nearest decided block of their region; blocks inside named boilerplate lend none.

    At equal distance text wins in an article and for blocks of some length; without any decided block in reach a block stays.
    """
    regions: dict[int, list[Block]] = {}
    for b in page:
        if b.kind != BOILERPLATE and (b.label is not False or b.kind != ARTICLE_HEADER):
            regions.setdefault(b.region, []).append(b)
    for own in regions.values():
        n = len(own)
        before, after = [(n + 1, True)] * n, [(n + 1, True)] * n
        for nearest, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
            held, label = None, True
            for k in order:
                if own[k].label is not None:
                    held, label = k, own[k].label
                elif held is not None:
                    nearest[k] = (abs(k - held), label)
        for b, (left, a), (right, z) in zip(own, before, after):
            if b.label is None:
                keeps = b.region or b.kind == CONTENT or len(b.text) >= SHORT
                b.label = a if left < right else z if right < left else (a or z) if keeps else (a and z)


def main_text(html: str) -> tuple[str, int, int]:
    """(text, blocks, blocks kept) of a page."""
    page = blocks(html)
    first_pass(page)
    second_pass(page)
    kept = [b.text for b in page if b.label]
    return "\n".join(kept), len(page), len(kept)


def page_texts(pages: DataFrame, html: str = "html") -> DataFrame:
    """(row, text, n_chars, n_blocks, n_kept): the main text of every page, ``row`` holding the other columns.

    A page is cut into blocks where block elements start or end. A first pass labels blocks by the container that their markup
    names, by their share of linked characters, their length and their share of stop words; a second pass gives ambiguous ones,
    mostly short, the label of the nearest decided block. Inside an article or main element, blocks are text unless markup or links
    say otherwise, and what lies outside is not. Kept blocks are joined by line feeds. Pages are independent, so nothing is shuffled.

    Defined cases: a null or empty page has empty text; markup may be cut off or badly nested, an open comment or script swallows the
    rest; a page of plain text is its own text; repeated rows stay; an empty table gives no rows.
    """
    others = [F.col(f"`{c}`") for c in pages.columns if c != html]
    row = F.struct(*others) if others else F.struct(F.lit(None).cast("string").alias("none"))
    rows = pages.select(row.alias("row"), F.col(f"`{html}`").cast("string").alias("html"))
    out = T.StructType([rows.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()),
                        T.StructField("n_blocks", T.LongType()), T.StructField("n_kept", T.LongType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [main_text(h or "") for h in b.column("html").to_pylist()]
            texts, n_blocks, n_kept = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(n_blocks, pa.int64()), pa.array(n_kept, pa.int64())],
                names=["row", "text", "n_chars", "n_blocks", "n_kept"])

    return rows.mapInArrow(read, out)
