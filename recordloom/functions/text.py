"""Row-wise text functions: cleaning, repair, tokens, run ids.

Everything here is a built-in expression over one column; nothing shuffles and
nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions.columns import as_column, let, literal, over

# They must equal the original behaviour for results to match.
WORD_CHAR = r"[\p{L}\p{N}_]"
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
WORD_PATTERN = r"[\p{L}\p{N}_]+"
STRUCTURAL_QUOTE = rf"(?<!{WORD_CHAR})'(?!')|(?<!')'(?!{WORD_CHAR})"
UNESCAPED_QUOTE = r"(?<!\\)(?<!\\')'"
OUTER_WHITESPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
BUDGET_FACTOR = 1.1
RUN_ID_FORMAT = "yyyy-MM-dd HH:mm:ss"


def strip_apostrophes(text: Column | str) -> Column:
    return F.replace(as_column(text), F.lit("'"), F.lit(""))


def strip_backslashes(text: Column | str) -> Column:
    return F.replace(as_column(text), F.lit("\\"), F.lit(""))


def strip_whitespace(text: Column | str) -> Column:
    """Strip white space of any kind, not only blanks, from both ends."""
    return F.regexp_replace(as_column(text), OUTER_WHITESPACE, "")


def repair_record_text(text: Column | str, repair: str = "parity") -> Column:
    """Turn the printed form of a Python dict into JSON text.

    ``parity`` applies the six rewrites of the original, including the lossy last two
    (``/`` becomes `` or ``, a doubled quote becomes one). ``safe`` leaves those two out
    and instead translates the literals ``None``, ``nan``, ``True`` and ``False`` wherever
    they stand outside a quoted string; text that already is a JSON object stays as it is.
    """
    if repair not in ("parity", "safe"):
        raise ValueError(f"repair must be 'parity' or 'safe', not {repair!r}")
    out = F.replace(as_column(text), F.lit(" 'S"), F.lit("'S"))
    if repair == "parity":
        out = F.replace(out, F.lit(" nan,"), F.lit('"None",'))
    out = F.regexp_replace(out, STRUCTURAL_QUOTE, '"')
    out = F.replace(out, F.lit("\n"), F.lit(" "))
    if repair == "parity":
        out = F.replace(out, F.lit("/"), F.lit(" or "))
        return F.replace(out, F.lit('""'), F.lit('"'))
    given = as_column(text)
    is_json = F.startswith(F.ltrim(given), F.lit("{")) & F.try_parse_json(given).isNotNull()
    return F.when(is_json, given).otherwise(_translate_literals(out))


def _translate_literals(text: Column) -> Column:
    segments = F.split(text, r'(?<!\\)"', -1)
    none, true, false = (literal(rf"\b(?:{word})\b") for word in ("None|nan", "True", "False"))
    outside = (
        f"regexp_replace(regexp_replace(regexp_replace(s, {none}, 'null'), {true}, 'true'), {false}, 'false')"
    )
    return over(
        lambda segments: f"array_join(transform({segments}, (s, i) -> if(i % 2 = 0, {outside}, s)), '\"')",
        segments=segments,
    )


def single_to_double_quotes(text: Column | str) -> Column:
    """Make every unescaped single quote a double one, unless the text already uses double quotes."""
    text = as_column(text)
    second = F.substring(F.replace(strip_whitespace(text), F.lit("\n"), F.lit("")), 2, 1)
    return F.when(second.isin('"', ""), text).otherwise(F.regexp_replace(text, UNESCAPED_QUOTE, '"'))


def first_json_object(text: Column | str) -> Column:
    """First brace-balanced object of a text; braces inside strings count; null if there is none.

    The text is cut behind every brace and the pieces are folded once, so the cost is
    linear in the length of the text however many braces it has.
    """
    text = as_column(text)
    pieces = F.regexp_extract_all(text, F.lit(r"[^{}]*[{}]"), F.lit(0))
    step = """
        CASE WHEN acc.last > 0 THEN acc
             WHEN endswith(piece, '{') THEN struct(
                 acc.offset + length(piece) AS offset,
                 acc.depth + 1 AS depth,
                 if(acc.depth = 0, acc.offset + length(piece), acc.first) AS first,
                 0 AS last)
             ELSE struct(
                 acc.offset + length(piece) AS offset,
                 acc.depth - 1 AS depth,
                 acc.first AS first,
                 if(acc.depth = 1, acc.offset + length(piece), 0) AS last)
        END"""

    def body(text: str, pieces: str) -> str:
        start = "struct(0 AS offset, 0 AS depth, 0 AS first, 0 AS last)"
        found = f"aggregate({pieces}, {start}, (acc, piece) -> {step})"
        cut = f"CASE WHEN f.last > 0 THEN substring({text}, f.first, f.last - f.first + 1) END"
        return let(found, "f", cut)

    return F.when(F.contains(text, F.lit("{")) & F.contains(text, F.lit("}")), over(body, text=text, pieces=pieces))


def tokens(text: Column | str) -> Column:
    """Lower-case words of two or more word characters."""
    return F.regexp_extract_all(F.lower(as_column(text)), F.lit(TOKEN_PATTERN), F.lit(0))


def words(text: Column | str) -> Column:
    """Lower-case words of any length; used to compare short field values."""
    return F.regexp_extract_all(F.lower(as_column(text)), F.lit(WORD_PATTERN), F.lit(0))


def token_count(text: Column | str) -> Column:
    return F.size(tokens(text))


def buffered_budget(count: Column | str) -> Column:
    """Token count with a margin of a tenth, floored."""
    return F.floor(F.lit(BUDGET_FACTOR) * as_column(count)).cast("int")


def chunks(text: Column | str, size: int, overlap: int) -> Column:
    """Overlapping fixed-width pieces that cover the whole text, in order."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    text = as_column(text)
    step = size - overlap
    last = F.greatest(F.length(text) - overlap - 1, F.lit(0))
    starts = F.sequence(F.lit(0), last, F.lit(step))
    return over(
        lambda text, starts: f"transform({starts}, start -> substring({text}, start + 1, {int(size)}))",
        text=text,
        starts=starts,
    )


def run_id(moment: Column | str) -> Column:
    return F.date_format(as_column(moment), RUN_ID_FORMAT)


def run_path(base: str, name: Column | str, moment: Column | str) -> Column:
    return F.concat_ws("/", F.lit(base), as_column(name), run_id(moment))
