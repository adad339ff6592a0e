"""Fill-in-the-middle: documents cut in three, their blocks exchanged in place by rotations, and put back again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import pieces

# The marks before prefix, suffix and middle, and the shares of a hundred that set the form.
SENTINELS = ("<P>", "<S>", "<M>")
CHANGED = 90
SUFFIX_FIRST = 20
SEED = "1"
SWAP_BYTES = 1 << 16


def reverse(buffer: np.ndarray, start: int, end: int) -> None:
    """Reverse a stretch of bytes where it lies; both ends are swapped block by block, with two small copies."""
    while end - start > 1:
        step = min(SWAP_BYTES, (end - start) // 2)
        head = buffer[start : start + step][::-1].copy()
        buffer[start : start + step] = buffer[end - step : end][::-1].copy()
        buffer[end - step : end] = head
        start, end = start + step, end - step


def rotate(text: bytearray, start: int, middle: int, end: int) -> None:
    """Exchange the neighbouring blocks start..middle and middle..end: each is reversed, then both together."""
    buffer = np.frombuffer(text, np.uint8)
    reverse(buffer, start, middle)
    reverse(buffer, middle, end)
    reverse(buffer, start, end)


def byte_offsets(text: bytes, first: int, second: int) -> tuple[int, int]:
    """Byte places of two places given in code points."""
    if text.isascii():
        return first, second
    leads = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return tuple(int(leads[place]) if place < len(leads) else len(text) for place in (first, second))


def arrange(text: bytes, form: str, first: int, second: int, marks: tuple[bytes, bytes, bytes]) -> bytes:
    """The text with its marks, cut after `first` and `second` code points, in the order of its form."""
    if form == "plain":
        return text
    first, second = byte_offsets(text, first, second)
    prefix, suffix, middle = marks
    buffer = bytearray(text)
    for place, mark in ((second, suffix), (first, middle), (0, prefix)):
        buffer[place:place] = mark
    # now: prefix mark, prefix, middle mark, middle, suffix mark, suffix
    begin = len(prefix) + first
    cut = begin + len(middle) + second - first
    rotate(buffer, begin if form == "psm" else 0, cut, len(buffer))
    return bytes(buffer)


def restore(output: bytes, form: str, marks: tuple[bytes, bytes, bytes]) -> bytes:
    """The text before `arrange`, from its output and form alone."""
    if form == "plain":
        return output
    prefix, suffix, middle = marks
    buffer = bytearray(output)
    # The exchanged blocks change back by the rotation with their lengths exchanged.
    if form == "psm":
        start = buffer.index(suffix)
        rotate(buffer, start, buffer.index(middle), len(buffer))
    else:
        start = 0
        rotate(buffer, start, buffer.index(prefix), len(buffer))
    for mark in (suffix, middle, prefix):
        place = buffer.index(mark)
        del buffer[place : place + len(mark)]
    return bytes(buffer)


def cuts(id_column: Column, text: Column, sentinels: tuple[str, str, str], changed: int, suffix_first: int, seed: str) -> Column:
    """STRUCT<n, form, first, second> of a text, from four 32-bit numbers of the SHA-256 sum of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))).cast("binary"), 256)
    h1, h2, h3, h4 = (F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4))
    n = F.length(text).cast("long")
    marked = F.lit(False)
    for mark in sentinels:
        marked = marked | F.contains(text, F.lit(mark))
    plain = (n == 0) | marked | (h3 % 100 >= changed)
    form = F.when(plain, "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    a, b = h1 % (n + 1), h2 % (n + 1)
    first, second = (F.when(~plain, side) for side in (F.least(a, b), F.greatest(a, b)))
    return F.struct(n.alias("n"), form.alias("form"), first.alias("first"), second.alias("second"))


def _marks(sentinels: tuple[str, str, str]) -> tuple[bytes, bytes, bytes]:
    """The marks as bytes. One mark may not hold, or begin with the end of, another: they could not be found again."""
    marks = tuple(mark.encode() for mark in sentinels)
    clash = any(
        a.find(b) >= 0 if i != j else False for i, a in enumerate(marks) for j, b in enumerate(marks)
    ) or any(a[-k:] == b[:k] for a in marks for b in marks for k in range(1, min(len(a), len(b))))
    if not all(marks) or clash:
        raise ValueError("sentinels must be three texts of which none holds or overlaps another or itself")
    return marks


def fill_in_middle(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    sentinels: tuple[str, str, str] = SENTINELS,
    changed: int = CHANGED,
    suffix_first: int = SUFFIX_FIRST,
    seed: str = SEED,
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row.

    A text of n code points is cut at two places that the SHA-256 sum of seed and id sets. Of a hundred texts
    `changed` are rearranged, of a hundred of these `suffix_first` as suffix, prefix, middle (spm), the others as
    prefix, suffix, middle (psm); texts that are empty or hold a sentinel stay as they are (plain), with null
    lengths. A null text counts as empty, a null id as an empty text. Blocks are exchanged in one buffer for each
    text. Rows stay where they are: no shuffle; repeated rows come out as often as they went in, an empty table
    gives an empty result, and other columns, whatever their names, are not read.
    """
    marks = _marks(sentinels)
    whole = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), whole.alias("text"))
    placed = narrow.select("doc_id", "text", cuts(F.col("doc_id"), F.col("text"), sentinels, changed, suffix_first, seed).alias("cut"))
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
         ("middle_chars", pa.int64()), ("output", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            forms = piece.column("form")
            firsts, seconds = piece.column("first"), piece.column("second")
            changes = zip(
                piece.column("text").cast(pa.binary()).to_pylist(),
                *(column.to_pylist() for column in (forms, firsts, seconds)),
                strict=True,
            )
            outputs = pa.array([arrange(*change, marks) for change in changes], pa.binary()).cast(pa.string())
            lengths = pa.compute.subtract(seconds, firsts)
            columns = [piece.column("doc_id"), piece.column("n"), forms, firsts, lengths, outputs]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return placed.select("doc_id", "text", "cut.*").mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restored(
    transformed: DataFrame, output: str = "output", form: str = "form", sentinels: tuple[str, str, str] = SENTINELS
) -> DataFrame:
    """Add `restored`, the text before the transformation, which output and form alone give back exactly."""
    marks = _marks(sentinels)
    names = [name for name in transformed.columns if name != "restored"]
    schema = transformed.select(*[f"`{name}`" for name in names]).withColumn("restored", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, output):
            outputs = piece.column(output).cast(pa.binary()).to_pylist()
            forms = piece.column(form).to_pylist()
            texts = [value if value is None else restore(value, kind, marks) for value, kind in zip(outputs, forms, strict=True)]
            columns = [*piece.columns, pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*piece.schema.names, "restored"])

    return transformed.select(*[f"`{name}`" for name in names]).mapInArrow(run, schema)


def digests(found: DataFrame) -> DataFrame:
    """The result of `restored` with digests in place of the texts."""
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )
