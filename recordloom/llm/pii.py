"""Personal numbers and dates in texts, replaced by keyed permutations of their own format."""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import pieces

KEY = b"replace this key in production"
ROUNDS = 10
FIRST_DAY, DAYS = datetime.date(1900, 1, 1), 73_049  # 1900-01-01 to 2099-12-31
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"

FIND = re.compile(
    r"(?P<email>(?<![\w.+%-])[A-Za-z0-9](?:[A-Za-z0-9._+%-]*[A-Za-z0-9])?(?=@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}))"
    r"|(?P<secret>(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z]))"
    r"|(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d))"
    r"|(?P<date>(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}(?=[Tt]\d{2}(?::?\d{2})?)|(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\w/-]|\.\d)))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?!\w|-(?!\d)|\.\d))",
    re.ASCII,
)
GROUP = re.compile(r"\d+", re.ASCII)
GROUP_END = re.compile(r"(?!\w|-(?!\d)|\.\d)", re.ASCII)
# lengths of the groups of digits that card numbers are usually written in
USUAL = ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3))


def permute(value: list[int], radix: int, key: bytes, tweak: bytes) -> list[int]:
    """A Feistel network over digits of a radix: a permutation of all values of that length."""
    n = len(value)
    left, right = value[: n // 2], value[n // 2 :]
    for turn in range(ROUNDS):
        data = b"%d %d %d " % (n, radix, turn) + bytes(right)
        mixed = int.from_bytes(hashlib.blake2b(data, key=key, person=tweak, digest_size=32).digest(), "big")
        number = 0
        for digit in left:
            number = number * radix + digit
        number = (number + mixed) % radix ** len(left)
        digits = []
        for _ in left:
            number, digit = divmod(number, radix)
            digits.append(digit)
        left, right = right, digits[::-1]
    return left + right


def _digits(text: str, key: bytes, tweak: bytes) -> str:
    return "".join(map(str, permute([int(c) for c in text], 10, key, tweak)))


def _laid(shape: str, digits: str) -> str:
    """Digits in place of the digits of a text."""
    given = iter(digits)
    return "".join(next(given) if c.isdigit() else c for c in shape)


def check_digit(digits: str) -> str:
    """What makes a card number valid behind the given digits."""
    doubled = [int(c) * 2 if i % 2 == 0 else int(c) for i, c in enumerate(reversed(digits))]
    return str(-sum(d - 9 if d > 9 else d for d in doubled) % 10)


def valid_ssn(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def _date(text: str) -> tuple[str, datetime.date] | None:
    """The format and the day; between slashes the month comes first only where it cannot come second."""
    shapes = ("%Y-%m-%d",) if text[4] == "-" else ("%d/%m/%Y", "%m/%d/%Y") if "/" in text else ("%d.%m.%Y",)
    for shape in shapes:
        try:
            day = datetime.datetime.strptime(text, shape).date()
        except ValueError:
            continue
        return (shape, day) if 0 <= (day - FIRST_DAY).days < DAYS else None
    return None


def _cards(text: str, start: int) -> list[tuple[int, bool]]:
    """Ends of the valid card numbers made of whole groups of digits from `start`, and whether usual; longest first."""
    found, digits, sizes = [], "", []
    while (group := GROUP.match(text, start)) and len(digits) + len(group.group()) <= 19:
        digits += group.group()
        sizes.append(len(group.group()))
        start = group.end() + 1
        if len(digits) >= 13 and GROUP_END.match(text, group.end()) and check_digit(digits[:-1]) == digits[-1]:
            found.append((group.end(), len(sizes) == 1 or tuple(sizes) in USUAL))
        if text[group.end() : start] not in (" ", "-"):
            break
    return found[::-1]


def card_span(text: str, start: int, end: int) -> tuple[int, int] | int:
    """Start and end of the card number in a run of groups of digits, or where to search on.

    Groups before or behind a number, such as a date of expiry, do not hide it. A number in usual groups goes
    before one that overlaps it and is valid by chance.
    """
    while True:
        group = GROUP.match(text, start)
        found = _cards(text, start)
        usual = [stop for stop, is_usual in found if is_usual]
        if usual:
            return start, usual[0]
        later = [m.start() for m in GROUP.finditer(text, group.end(), found[0][0])] if found else []
        if found and not any(is_usual for place in later for _, is_usual in _cards(text, place)):
            return start, found[0][0]
        start = group.end() + 1
        if start >= end or text[start - 1] != "-":  # groups behind a blank are found from there by themselves
            return group.end()


def pseudonym(kind: str, text: str, key: bytes) -> str | None:
    """The replacement of a value of the same format, or nothing if the value is not valid."""
    tweak = kind.encode()
    if kind == "email":
        plain = [c for c in text.lower() if c in LETTERS]
        given = iter(permute([LETTERS.index(c) for c in plain], 36, key, tweak))
        return "".join(LETTERS[next(given)] if c in LETTERS else c for c in text.lower())
    if kind == "secret":
        made = "".join("%x" % d for d in permute([int(c, 16) for c in text], 16, key, tweak))
        return made.upper() if text != text.lower() else made
    if kind == "ip":
        parts = [int(part) for part in text.split(".")]
        return ".".join(map(str, permute(parts, 256, key, tweak))) if max(parts) < 256 else None
    if kind == "date":
        found = _date(text)
        if not found:
            return None
        day = (found[1] - FIRST_DAY).days
        while True:  # walk along the cycle back into the range of days
            day = int(_digits(f"{day:05d}", key, tweak))
            if day < DAYS:
                made = FIRST_DAY + datetime.timedelta(day)
                if found[0] != "%m/%d/%Y" or made.day > 12:  # what has the month first stays readable in one way
                    return made.strftime(found[0])
    digits = "".join(c for c in text if c.isdigit())
    if kind == "phone":
        return _laid(text, digits[:-10] + _digits(digits[-10:], key, tweak))
    if kind == "ssn":
        made = digits
        while valid_ssn(digits) and (made == digits or not valid_ssn(made)):  # walk along the cycle
            made = _digits(made, key, tweak)
            if made == digits:
                break
        return _laid(text, made) if valid_ssn(digits) else None
    if check_digit(digits[:-1]) == digits[-1]:
        made = _digits(digits[:-1], key, tweak)
        return _laid(text, made + check_digit(made))
    return None


def replace(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and start, end and kind of what they replace, in characters of the original."""
    made, spans, done, place = [], [], 0, 0
    while match := FIND.search(text, place):
        kind = match.lastgroup or ""
        start, place = match.span()
        if kind == "card":
            span = card_span(text, start, place)
            if isinstance(span, int):
                place = span
                continue
            start, place = span
        new = pseudonym(kind, text[start:place], key)
        if new is not None:
            made += [text[done:start], new]
            done = place
            spans.append((start, done, kind))
    return "".join([*made, text[done:]]), spans


SPANS = "pii_spans"


def pseudonymised(docs: DataFrame, text: str = "text", key: bytes = KEY) -> DataFrame:
    """The table with personal values in the texts replaced, and `pii_spans`: start, end (characters of the original)
    and kind of each.

    Valid dates (1900 to 2099; between slashes with the month first where it cannot come second), IPv4 addresses, phone and social security numbers, card numbers with a right check
    digit, local parts of mail addresses and long hexadecimal secrets go through a keyed Feistel network over
    their own digits: the result is valid and of the same format, and equal values get equal pseudonyms in all
    documents. Numbers that are not valid stay. A permutation may leave a rare value as it is. Null texts stay
    null, empty ones empty; whole texts are searched; rows stay in place and come out as often as they went in; a
    column called `pii_spans` is replaced. `key` must be 1 to 64 secret bytes.
    """
    kept = [name for name in docs.columns if name != SPANS]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            texts, spans = [], []
            for value in batch.column(text).to_pylist():
                new, found = replace(value, key) if value else (value, [])
                texts.append(new)
                spans.append([{"start": s, "end": e, "kind": k} for s, e, k in found])
            arrays = [pa.array(texts, pa.string()) if name == text else batch.column(name) for name in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(spans, kind)], names=[*kept, SPANS])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields]
    fields.append(f"{SPANS} array<struct<start:int,end:int,kind:string>>")
    return docs.select(*kept).mapInArrow(run, ", ".join(fields))
