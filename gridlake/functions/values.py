"""Cell value parsing, tokenising and classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference's tokenizer): words dropped from every token list.
STOP_WORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is"]
# A token must be longer than this many bytes.
MIN_TOKEN_BYTES = 2

# Unicode white space, on which the reference splits words.
SPACES = ["\t", "\n", "\x0b", "\f", "\r", " ", "\x85", "\xa0", "\u1680", "\u2000-\u200a", "\u2028", "\u2029", "\u202f",
          "\u205f", "\u3000"]

_NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
_SPACES = "[ \u00a0\u202f\t]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize(text) -> Column:
    """lower-case, split on Unicode white space, keep words of more than 2 bytes that are not stop words.

    No punctuation stripping (``"widget,"`` is its own token), like the reference.
    """
    words = F.split(F.lower(_c(text)), "[" + "".join(SPACES) + "]+")
    return F.filter(words, lambda w: (F.octet_length(w) > MIN_TOKEN_BYTES) & ~w.isin(STOP_WORDS))


def parse_number(value) -> Column:
    """a cell's text as DOUBLE when the whole trimmed text is a decimal number, else null.

    Guarded by a regex because a bare cast also accepts 'NaN', 'Infinity' and '1d'.
    """
    v = F.trim(_c(value))
    return F.when(v.rlike(_NUMBER), v.try_cast("double"))


def is_text(value) -> Column:
    """F8: non-empty and not a number."""
    v = _c(value)
    return v.isNotNull() & (v != "") & parse_number(v).isNull()


def parse_money(value, mode: str = "strict") -> Column:
    """financial text -> DOUBLE.  Spaces (incl. no-break spaces) are dropped, ``,`` becomes ``.``.

    ``strict`` (default) needs the whole rest to be a number; ``prefix`` reproduces the
    reference's scan of the longest numeric prefix (``"12abc"`` -> 12.0).
    """
    cleaned = F.regexp_replace(F.regexp_replace(_c(value), _SPACES, ""), ",", ".")
    if mode == "strict":
        return F.when(cleaned.rlike(_NUMBER), cleaned.try_cast("double"))
    if mode == "prefix":
        head = F.regexp_extract(cleaned, r"^([+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?)", 1)
        return F.when(head != "", head.try_cast("double"))
    raise ValueError(f"unknown mode {mode!r}")


def cell_kind(value, num, formula) -> Column:
    """P13: 'formula' | 'number' | 'text' (dates are set by the workbook reader)."""
    return (F.when(_c(formula).isNotNull(), "formula")
            .when(_c(num).isNotNull(), "number")
            .when(_c(value).isNotNull() & (_c(value) != ""), "text"))


def name_prefix(name) -> Column:
    """text before the first ``_``, else before the first space; a separator at position 1 is ignored."""
    n = _c(name)
    u, s = F.instr(n, "_"), F.instr(n, " ")
    return (F.when(u > 1, F.substring_index(n, "_", 1))
            .when(s > 1, F.substring_index(n, " ", 1))
            .otherwise(n))


# The naming patterns of the reference, in its order.
NAMING_PATTERNS = ["underscore_separated", "space_separated", "starts_with_number", "contains_year"]
YEARS = ["2023", "2024", "2025"]


def naming_flags(name) -> dict[str, Column]:
    """the four naming-pattern flags of one name."""
    n = _c(name)
    return {
        "underscore": n.contains("_"),
        "space": n.contains(" "),
        "digit": n.rlike("^[0-9]"),
        "has_year": F.exists(F.array(*[F.lit(y) for y in YEARS]), lambda y: F.instr(n, y) > 0),
    }


def sanitise(text) -> Column:
    """prefix ``'`` when text starts with ``= + - @`` so a spreadsheet shows it as text."""
    t = _c(text)
    return F.when(t.rlike("^[=+\\-@]"), F.concat(F.lit("'"), t)).otherwise(t)
