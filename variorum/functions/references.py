"""Scalars over ids, titles, by-lines and citations of scriptures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import chinese_numeral, parse_chinese_numeral

#: The form of an id (canon, volume, number, letter, part), digits of volumes, and how many volumes canons have.
SCRIPTURE = r"^([A-Za-z])(?:(\d{2})n)?\s*(\d{3,5})([A-Za-z]?)(?:_(\d{3}))?$"
VOLUMES = {"T": 55, "X": 30}
OTHER_VOLUMES = 99
NUMERAL = "[0-9]+|[零〇一二三四五六七八九十百千两兩]+"


def scripture_id(s: Column) -> Column:
    """C20: canon, volume (with its canon), number (four digits at least), letter and part of an id, '' for what it lacks; null for what is no id."""
    s = F.trim(s)
    part = lambda k: F.regexp_extract(s, SCRIPTURE, k)
    number = F.lpad(part(3), F.greatest(F.length(part(3)), F.lit(4)), F.lit("0"))
    volume = F.when(part(2) != "", F.concat(F.upper(part(1)), part(2))).otherwise("")
    found = F.struct(F.upper(part(1)).alias("canon"), volume.alias("volume"), number.alias("number"), part(4).alias("letter"), part(5).alias("part"))
    return F.when(s.rlike(SCRIPTURE), found)


def volume_candidates(canon: Column, volume: Column) -> Column:
    """C20: the volumes in which a work may stand: its own, or all of its canon."""
    n = F.lit(OTHER_VOLUMES)
    for name, volumes in VOLUMES.items():
        n = F.when(canon == name, volumes).otherwise(n)
    every = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(canon, F.lpad(i.cast("string"), 2, "0")))
    return F.when(volume != "", F.array(volume)).otherwise(every)


def volume_of(query: Column) -> Column:
    """Title and volume of a query such as 論卷第三, 論第三卷 or 論卷3; the whole and null where it names none."""
    q = F.regexp_replace(query, r"\s+", "")
    title, volume = q, F.lit(None).cast("int")
    for form in reversed((f"^(.+?)卷第?({NUMERAL})$", f"^(.+?)第({NUMERAL})卷$")):
        found = F.regexp_extract(q, form, 2)
        digits = found.rlike("^[0-9]+$")
        n = F.when(~digits, parse_chinese_numeral(found))
        n = F.coalesce(F.when(digits, found).try_cast("int"), n)
        held = (found != "") & (n > 0)
        title, volume = F.when(held, F.regexp_extract(q, form, 1)).otherwise(title), F.when(held, n).otherwise(volume)
    return F.struct(title.alias("title"), volume.alias("volume"))


def with_volume(title: Column, volume: Column) -> Column:
    """The title with another volume (1 to 999), in the form that it has."""
    n = chinese_numeral(volume)
    out = title
    for form, before, after in reversed(((f"卷第(?:{NUMERAL})", "卷第", ""), (f"第(?:{NUMERAL})卷", "第", "卷"), (f"卷(?:{NUMERAL})$", "卷", ""))):
        out = F.when(title.rlike(form), F.regexp_replace(title, F.lit(form), F.concat(F.lit(before), n, F.lit(after)))).otherwise(out)
    return out


#: What follows the names of translators and authors, and the name of those that are not known.
TRANSLATED, WRITTEN, UNKNOWN = "譯|译", "造|撰|作|述|集|說|说|注|註|疏|記|记", "未知"


def person(byline: Column, verbs: str, longest: int) -> Column:
    """The last name before one of the verbs."""
    found = F.regexp_extract_all(byline, F.lit(rf"([\x{{4E00}}-\x{{9FFF}}A-Za-z·．・]{{1,{longest}}})(?:{verbs})"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(UNKNOWN))


def translator(byline: Column) -> Column:
    return person(byline, TRANSLATED, 20)


def author(byline: Column) -> Column:
    return person(byline, WRITTEN, 30)


#: Pauses after marks, in milliseconds.
PAUSES = {"。": 500, "！": 500, "？": 500, "，": 300, "、": 200, "；": 400}


def speech(t: Column, phonemes: dict[str, str] | None = None) -> Column:
    """The text with pauses after marks, and words (phonemes: word, sound) that are spoken otherwise."""
    for mark, ms in PAUSES.items():
        t = F.replace(t, F.lit(mark), F.lit(f"{mark}<break time='{ms}ms'/>"))
    for word, sound in (phonemes or {}).items():
        t = F.replace(t, F.lit(word), F.lit(f"<phoneme alphabet='sapi' ph='{sound}'>{word}</phoneme>"))
    return t


#: A range citation, what makes it none, and the openings that do not belong to the text cited.
RANGE = r"([^\n\[\]]{2,30})[(（]至[)）]([^\n。\[\]]{2,40})[。]"
COMMENTARY = "^(?:述曰|解云|釋曰|释曰|疏曰|記曰|记曰)"
OPENING = r"^(?:論曰|论曰|頌曰|颂曰|經曰|经曰|論云|论云|經云|经云)[:：]?\s*"


def range_citations(t: Column) -> Column:
    """L2: head...tail of each passage that is cited by its first and last words."""
    heads, tails = (F.regexp_extract_all(t, F.lit(RANGE), F.lit(k)) for k in (1, 2))
    both = F.zip_with(heads, tails, lambda h, x: F.struct(F.trim(h).alias("h"), F.trim(x).alias("x")))
    long = lambda s: F.length(s) >= 2
    good = F.filter(both, lambda c: long(c["h"]) & long(c["x"]) & ~c["h"].rlike(COMMENTARY))
    clean = F.transform(good, lambda c: F.struct(F.regexp_replace(c["h"], OPENING, "").alias("h"), c["x"].alias("x")))
    return F.transform(F.filter(clean, lambda c: long(c["h"])), lambda c: F.concat(c["h"], F.lit("..."), c["x"]))
