"""What a search pattern requires: literal pieces that every match contains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE_LENGTHS = (8, 4, 2, 1)

# Stands for anything that is no plain text; no pattern or code contains it.
GAP = "\x00"
_GROUP_LEVELS = 4


def _replace(text: Column, pattern: str, by: str = GAP) -> Column:
    return F.regexp_replace(text, pattern, by)


def required_texts(pattern: Column) -> Column:
    """For each alternative of a regular expression its longest plain text; null if one is not known to have any.

    Every match of the pattern contains one of these texts. Escapes, classes, anchors and
    optional parts are gaps; groups are opened, or are gaps if they hold alternatives or may be
    left out. Whatever is not understood (flags, look-around, quoting, named characters, nested
    classes) makes the result null, so a text is never required by mistake.
    """
    odd = (
        F.contains(pattern, F.lit(GAP))
        | pattern.rlike(r"\\[QEpPxucNk0]|\\$")  # quoting, named or numbered characters, a lone escape
        | pattern.rlike(r"\(\?(?!:)")  # flags, look-around, named groups
    )
    rest = _replace(pattern, r"(?s)\\.")
    rest = _replace(rest, r"\[\^?\]?[^\[\]]*\]")
    rest = _replace(rest, r"\(\?:", "(")
    odd = odd | rest.rlike(r"[\[\]]|&&")  # unions and intersections of classes
    for _ in range(_GROUP_LEVELS):
        rest = _replace(rest, r"\([^()]*\)(?:[?*]|\{[^{}]*\})[?+]?")
        rest = _replace(rest, r"\([^()|]*\|[^()]*\)")
        rest = _replace(rest, r"\(([^()|]*)\)", f"{GAP}$1{GAP}")
    odd = odd | rest.rlike(r"[()]")
    rest = _replace(rest, r"[^|](?:[?*]|\{[^{}]*\})[?+]?")
    odd = odd | rest.rlike(r"[?*{}]")
    rest = _replace(rest, r"[.^$+]")
    longest = lambda alternative: F.element_at(
        F.sort_array(F.transform(F.split(alternative, GAP), lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))), -1
    )["t"]
    # A negative limit keeps an empty last alternative, which matches everything.
    texts = F.transform(F.split(rest, r"\|", -1), longest)
    return F.when(~odd & ~F.exists(texts, lambda t: t == ""), texts)


def required_pieces(pattern: Column, mode: str = "regex") -> Column:
    """The index keys of a pattern: the required texts, cut to a listed length; [""] if there are none."""
    texts = required_texts(pattern) if mode == "regex" else F.array(pattern)
    cut = lambda t: F.coalesce(
        *[F.when(F.length(t) >= n, F.substring(t, 1, n)) for n in PIECE_LENGTHS], F.lit("")
    )
    return F.array_distinct(F.coalesce(F.transform(texts, cut), F.array(F.lit(""))))


def pieces_of(value: Column) -> Column:
    """All texts of the listed lengths in a value, and the empty one: the keys under which patterns find it."""
    of_length = lambda n: F.when(
        F.length(value) >= n,
        F.transform(F.sequence(F.lit(1), F.length(value) - (n - 1)), lambda i: F.substr(value, i, F.lit(n))),
    )
    found = [F.coalesce(of_length(n), F.array().cast("array<string>")) for n in PIECE_LENGTHS]
    return F.when(value.isNotNull(), F.array_distinct(F.concat(F.array(F.lit("")), *found)))
