"""Text scalars: normalisers, strippers, splitters, escapers. All are expressions of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .marks import BRACKETS, INNER, J_NOT_MARK, J_SPACE, MARKS, QUOTES, SENTENCE_END, SPACES, ZERO_WIDTH, in_class


def normalize_collation(t: Column) -> Column:
    """Without line breaks, any white space and zero-width characters; punctuation stays."""
    return F.translate(t, SPACES + ZERO_WIDTH, "")


def normalize_layout(t: Column) -> Column:
    """Without line breaks, tabs and ideographic spaces; runs of spaces are one, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[\r\n\t\x{3000}]", ""), " +", " "))


def normalize_sentence(t: Column) -> Column:
    """Runs of line breaks are a space, runs of white space one; none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[\r\n]+", " "), f"{J_SPACE}+", " "))


def remove_empty_lines(t: Column) -> Column:
    """C4: one line, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\r\n?", "\n"), r"[\n\t \x{3000}]+", " "))


def strip_marks(t: Column) -> Column:
    """Without marks and white space."""
    return F.translate(t, MARKS + SPACES, "")


def strip_numbers_and_punctuation(t: Column) -> Column:
    """Without characters of the Unicode classes N and P, and wide and fixed spaces."""
    return F.regexp_replace(t, r"[\p{N}\p{P}\x{3000}\x{A0}]", "")


def gaps(t: Column) -> Column:
    """The marks before each character and after the last one; one more than characters. White space does not count."""
    return F.split(F.translate(t, SPACES, ""), J_NOT_MARK, -1)


def is_transposition(a: Column, b: Column) -> Column:
    """2 to 6 characters, the same ones in another order."""
    letters = lambda x: F.array_sort(F.split(x, ""))
    return (F.length(a) == F.length(b)) & F.length(a).between(2, 6) & (a != b) & (letters(a) == letters(b))


def mark_difference(a: Column, b: Column) -> Column:
    """C14: added, deleted or replaced; null where both are equal."""
    return (
        F.when(a == b, None)
        .when(a == "", "added")
        .when(b == "", "deleted")
        .when(F.startswith(b, a), "added")
        .when(F.startswith(a, b), "deleted")
        .otherwise("replaced")
    )


def mark_category(m: Column) -> Column:
    """The group of the first group with a mark in m."""
    groups = [("sentence", SENTENCE_END), ("inner", INNER), ("quote", QUOTES), ("bracket", BRACKETS)]
    out = F.lit("other")
    for name, marks in reversed(groups):
        out = F.when(m.rlike(f"[{in_class(marks)}]"), name).otherwise(out)
    return out


SENTENCE = r"[^.?!。？！]*[.?!。？！]+[\"”’」』]*|[^.?!。？！]+\z"


def sentences(t: Column) -> Column:
    """A sentence keeps its end marks and closing quotes; a tail without an end mark is one too."""
    return F.regexp_extract_all(t, F.lit(SENTENCE), F.lit(0))


def chinese_numeral(n: Column) -> Column:
    """1 to 999 in Chinese numerals."""
    digit = lambda d: F.substring(F.lit("一二三四五六七八九"), d.cast("int"), 1)
    h, t, u = F.floor(n / 100), F.floor(n % 100 / 10), n % 10
    hundreds = F.when(h > 0, F.concat(F.when(h > 0, F.element_at(F.split(F.lit("一二三四五六七八九"), ""), F.greatest(h, F.lit(1)).cast("int"))), F.lit("百"))).otherwise("")
    name = lambda d: F.element_at(F.split(F.lit("一二三四五六七八九"), ""), F.greatest(d, F.lit(1)).cast("int"))
    tens = F.when(t > 0, F.concat(F.when((t == 1) & (h == 0), "").otherwise(name(t)), F.lit("十"))).when((h > 0) & (u > 0), "零").otherwise("")
    return F.concat(hundreds, tens, F.when(u > 0, name(u)).otherwise(""))


def parse_chinese_numeral(s: Column) -> Column:
    """The number of a Chinese numeral below 10,000; 两 and 兩 are two, 零 and 〇 nothing."""
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("digit"))

    def step(acc: Column, c: Column) -> Column:
        d = F.when(c.isin("两", "兩"), 2).otherwise(F.instr(F.lit("一二三四五六七八九"), c))
        unit = F.when(c == "千", 1000).when(c == "百", 100).when(c == "十", 10)
        total = F.when(unit.isNotNull(), acc["total"] + F.greatest(acc["digit"], F.lit(1)) * unit).otherwise(acc["total"])
        return F.struct(total.alias("total"), F.when(d > 0, d).otherwise(0).alias("digit"))

    return F.aggregate(F.split(s, ""), start, step, lambda acc: acc["total"] + acc["digit"])


def latex_escape(t: Column) -> Column:
    """One pass over the characters, so no escape is escaped again."""
    # fixed values: the ten characters that LaTeX reserves
    table = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.array_join(F.transform(F.split(t, ""), lambda c: F.coalesce(F.element_at(pairs, c), c)), "")


def wrap(t: Column, width: int) -> Column:
    """Pieces of a fixed number of characters."""
    at = F.when(F.length(t) > 0, F.sequence(F.lit(1), F.length(t), F.lit(width))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.substring(t, i, F.lit(width)))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    p, q = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * 6371.0 * F.atan2(F.sqrt(a), F.sqrt(1 - a))
