"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import map_texts

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|textarea|template|noscript|iframe|svg|select|title|xmp|noembed|noframes)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<[/]?[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
MARKED = re.compile(r"""\b(?:class|id|role|aria-label|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)

# fixed values: tags that stand inside a line, that have no content, and that never hold main text
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data dfn em font i img ins kbd mark q s samp small span strike strong"
    " sub sup time tt u var wbr del label".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = set("nav header footer aside form button menu dialog head object audio video canvas".split())
SECTIONS = set("article main section div body html td th".split())
# fixed values: words in names of classes and ids of what surrounds main text
AROUND = set(
    "nav navbar navigation menu breadcrumb breadcrumbs header footer sidebar side aside ad ads advert advertisement"
    " adverts banner sponsor sponsored promo cookie cookies consent notice notices gdpr popup modal overlay newsletter"
    " subscribe signup login search form share sharing social related recommended comment comments reply replies"
    " disqus respond discussion widget toolbar pagination pager copyright legal tags meta contentinfo complementary"
    " topbar masthead".split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
PUNCTUATION = re.compile(r"[.,;:!?。、，；：！？¿¡…]")
LEAST = 0.1


def _outside(name: str, rest: str) -> bool:
    if name in OUTSIDE:
        return True
    if not rest or name in ("body", "html"):
        return False
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", rest, re.I))


def _named(name: str, rest: str) -> bool:
    """Whether a class, id or role has a word of what surrounds main text."""
    if not rest or name in ("body", "html"):
        return False
    return any(not AROUND.isdisjoint(re.split(r"[^a-z]+", found.lower())) for found in MARKED.findall(rest))


def blocks(page: str) -> list[tuple[tuple[str, ...], bool, str, int]]:
    """Blocks in page order: tag path, whether it lies outside of main text by name, text, characters in links.

    A name alone does not put an article or main element outside, nor what holds the first of them if all are held by
    named elements; if none has text left, nor what holds more than half of the text.
    """
    stack: list[tuple[str, bool | int]] = []  # an element outside by its name only has a number from 2 on
    found: list[tuple[tuple[str, ...], tuple[bool | int, ...], str, int]] = []
    holders: list[set[int]] = []
    numbers = 1
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            path = tuple(name for name, _ in stack if name not in INLINE)
            found.append((path, tuple(out for _, out in stack if out), text, min(linked, len(text))))
        parts.clear()
        linked = 0

    def pop_to(place: int) -> None:
        if any(name not in INLINE or out for name, out in stack[place:]):
            flush()
        del stack[place:]

    done = 0

    def take(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if any(name == "a" for name, _ in stack):
                linked += len(text.strip())

    for match in MARKUP.finditer(page):
        take(page[done : match.start()])
        done = match.end()
        name = (match.group("name") or "").lower()
        if not name:
            continue
        if match.group("close"):
            places = [i for i, (open_, _) in enumerate(stack) if open_ == name]
            if places:
                pop_to(places[-1])
            elif name not in INLINE:
                flush()
            continue
        rest = match.group("rest") or ""
        if name == "br":
            parts.append(" ")
            continue
        if name not in INLINE:
            flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    pop_to(i)
                    break
                if stack[i][0] in SECTIONS:
                    break
            if name == "body":
                heads = [i for i, entry in enumerate(stack) if entry[0] == "head"]
                if heads:
                    pop_to(heads[0])
            if name in CLOSES:
                ends, stops = CLOSES[name]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in stops:
                        break
                    if stack[i][0] in ends:
                        pop_to(i)
        if name not in VOID and not rest.endswith("/"):
            out: bool | int = _outside(name, rest)
            if not out and name not in ("article", "main") and _named(name, rest):
                numbers += 1
                out = numbers
            if out:
                flush()
            stack.append((name, out))
            if name in ("article", "main") and not any(mark is True for _, mark in stack):
                holders.append({mark for _, mark in stack if mark})
    take(page[done:])
    flush()
    wrapping = set() if not all(holders) else set().union(*holders[:1])
    if not any(wrapping.issuperset(marks) and ("article" in path or "main" in path) for path, marks, _, _ in found):
        held: dict[int, int] = defaultdict(int)
        whole = 0
        for _, marks, text, linked in found:
            if True not in marks:
                whole += len(text) - linked
                for mark in marks:
                    held[mark] += len(text) - linked
        wrapping |= {mark for mark, length in held.items() if 2 * length > whole}
    return [(path, not wrapping.issuperset(marks), text, linked) for path, marks, text, linked in found]


def _middle(weighted: list[tuple[float, int]]) -> float:
    """The smallest of the ratios up to which half of the blocks with own text lie."""
    values = sorted(value for value, own in weighted if own > 0)
    return values[(len(values) - 1) // 2] if values else 0.0


def main_blocks(page: str) -> list[str]:
    """Blocks whose tag path holds main text.

    For each path: characters outside of links per block, weighted by the punctuation per block. The ratio is
    smoothed with that of all paths of the same enclosing section, so headings and lists follow the paragraphs around
    them. Paths outside an article (or, without one, a main element) have none if there is one, as have paths outside
    by name. Without such an element, paths below a tenth of the ratio of the middle block go, so one
    long block does not outweigh the others; within it, only paths go that are nothing but links.
    """
    found = blocks(page)
    inside = [block for block in found if not block[1]]
    chosen = False
    for name in ("article", "main"):
        own = [block for block in inside if name in block[0]]
        if own:
            inside, chosen = own, True
            break
    sums: dict[tuple[str, ...], list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
    sections: dict[tuple[str, ...], tuple[str, ...]] = {}
    for path, _, text, linked in inside:
        place = next((i for i in range(len(path) - 1, -1, -1) if path[i] in SECTIONS), -1)
        if "article" in path or "main" in path:
            place = max(path.index(name) for name in ("article", "main") if name in path)
        sections[path] = path[: place + 1] + ("*",)
        for key in (path, sections[path]):
            total = sums[key]
            total[0] += max(0, len(text) - linked)
            total[1] += len(PUNCTUATION.findall(text))
            total[2] += 1
    ratio = {key: total[0] / total[2] * (1 + min(1.0, total[1] / total[2])) for key, total in sums.items()}
    fused = {path: (ratio[path] + ratio[section]) / 2 for path, section in sections.items()}
    least = 0.0 if chosen else LEAST * _middle([(fused[path], len(text) - linked) for path, _, text, linked in inside])
    return [text for path, _, text, _ in inside if fused[path] >= least and fused[path] > 0]


def extract(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row: main text, blocks joined by an empty line.

    Null, empty and markup-only pages give an empty text. Broken markup is read as browsers do in the common cases:
    open paragraphs and list items end where the next begins, what is open at the end is closed, a tag that is cut off
    is dropped. Whole pages are read, nothing is capped; rows stay in place and come out as often as they went in.
    """

    def run(batch: pa.RecordBatch) -> dict:
        texts = ["\n\n".join(main_blocks(value)) if value else "" for value in batch.column("html").to_pylist()]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": list(map(len, texts))}

    narrow = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return map_texts(narrow, "html", run, "page_id long, url string, text string, n_chars long")
