"""Many witnesses against one base: their readings on a common axis, the variant table, shared readings and similarity.

The axis has a place for every base character (pos, ord 0, inserted false) and, before each, places for what witnesses add
there (inserted true, ord from 0 on). Alignments of single witnesses meet on it in one union and one aggregation, so a
text is read once a witness and never pair by pair. Positions count from 0 in the base without layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .variants import classified

#: What stands for a missing character, and the characters of context on either side.
NONE, CONTEXT = "∅", 5
PLACE = ["pos", "inserted", "ord"]


def readings(aligned: DataFrame, key: str, witness: str, segments: str, entries: DataFrame, base: str | None = None) -> DataFrame:
    """a row for each place where a witness departs: key, witness, place, base, reading, category (variant or error by a dictionary of char and std, omission, addition), and with a base text its context before and after. segments is an array of them for each row."""
    return departures(aligned.select(key, witness, *([base] if base else []), F.inline(segments)), key, witness, entries, base)


def departures(segments: DataFrame, key: str, witness: str, entries: DataFrame, base: str | None = None) -> DataFrame:
    """What readings() gives, of a table with a row for each segment (type, text1, text2, i1). Replaced text is compared character by character; what is left over on one side is omitted or added after it. Rows come from generators, not from functions of array elements, so all of it is compiled; the context is cut from an array of characters, so its cost does not depend on the place."""
    chars = lambda t: F.when(t == "", F.array().cast("array<string>")).when(F.length(t) == 1, F.array(t)).otherwise(F.split(t, ""))
    text1, text2, k = F.col("text1"), F.col("text2"), F.col("_k")
    rows = segments.where("type <> 'equal'")
    own = [key, witness, "i1", F.length(text1).alias("_n")]
    if base is not None:
        own.append((F.col("_chars") if "_chars" in segments.columns else F.split(base, "")).alias("_chars"))
    rows = rows.select(*own, F.posexplode(F.arrays_zip(chars(text1).alias("a"), chars(text2).alias("b"))).alias("_k", "_x"))
    added, pos = k >= F.col("_n"), F.col("i1") + F.least(k, F.col("_n"))
    found = [pos.alias("pos"), added.alias("inserted"), F.greatest(k - F.col("_n"), F.lit(0)).alias("ord"), F.coalesce(F.col("_x.a"), F.lit(NONE)).alias("base"), F.coalesce(F.col("_x.b"), F.lit(NONE)).alias("reading")]
    if base is not None:
        first = F.greatest(pos - CONTEXT, F.lit(0))
        found += [F.array_join(F.slice("_chars", first + 1, pos - first), "").alias("before"), F.array_join(F.slice("_chars", pos + F.when(added, 1).otherwise(2), F.lit(CONTEXT)), "").alias("after")]
    told = classified(rows.select(key, witness, *found).where("base <> reading"), entries)
    kind = F.when(F.col("inserted"), "addition").when(F.col("reading") == NONE, "omission").otherwise(F.col("class"))
    return told.withColumn("category", kind).drop("class")


def variant_table(rows: DataFrame, key: str, witness: str, names: list[str]) -> DataFrame:
    """a row for each place, a column for each witness (w0, w1 … in the order of names; the base's character where it does not depart): position from 1, context, category by rank: omission, addition, variants if as many as errors at least, errors. Additions of several witnesses at one place share a row."""
    n = {c: F.count_if(F.col("category") == c) for c in ("omission", "addition", "variant", "error")}
    kind = F.when(n["omission"] > 0, "omission").when(n["addition"] > 0, "addition").when((n["variant"] > 0) & (n["variant"] >= n["error"]), "variant").otherwise("error")
    base = F.col("base")
    cells = [F.coalesce(F.max(F.when(F.col(witness) == w, F.col("reading"))), base).alias(f"w{k}") for k, w in enumerate(names)]
    context = F.concat(F.lit("..."), F.col("before"), F.lit("【"), base, F.lit("】"), F.col("after"), F.lit("...")).alias("context")
    wide = rows.groupBy(key, *PLACE, "base", "before", "after").agg(context, base.alias("base_char"), *cells, kind.alias("category"))  # a place has one base and one context
    return wide.select(key, (F.col("pos") + 1).alias("position"), "inserted", "ord", "context", "base_char", *(f"w{k}" for k in range(len(names))), "category")


def meetings(rows: DataFrame, key: str, witness: str) -> DataFrame:
    """Places where two witnesses depart: key, a < b, same (both read alike), category and other (of a and of b), added. A project has a few dozen witnesses at most, which bounds the pairs of a place."""
    at = rows.groupBy(key, *PLACE).agg(F.array_sort(F.collect_list(F.struct(F.col(witness).alias("w"), "reading", "category"))).alias("x")).where(F.size("x") > 1)
    pair = lambda p, q: F.struct(p["w"].alias("a"), q["w"].alias("b"), (p["reading"] == q["reading"]).alias("same"), p["category"].alias("category"), q["category"].alias("other"))
    pairs = F.flatten(F.transform("x", lambda p: F.transform(F.filter("x", lambda q: q["w"] > p["w"]), lambda q: pair(p, q))))
    return at.select(key, F.col("inserted").alias("added"), F.inline(pairs))


#: Classes of a departure, by number.
CATEGORIES = ["variant", "error", "omission", "addition"]


def alike_places(rows: DataFrame, key: str, witness: str, names: list[str]) -> DataFrame:
    """Places of a text at which the same witnesses read the same, as one with their number: key, added, x (witness, reading and category of all that depart; reading as its code point) and times. A witness reads once at a place, one character. A text has few different places, so what compares witnesses place by place does it once for each. Cells are numbers, so both aggregations are compiled and need no sort."""
    category = F.coalesce(*(F.when(F.col("category") == c, k) for k, c in enumerate(CATEGORIES)))
    cells = [f"_{k}" for k in range(len(names))]
    cell = F.ascii("reading") * len(CATEGORIES) + category
    at = rows.select(key, *PLACE, F.col(witness).alias("_w"), cell.alias("_c")).groupBy(key, *PLACE).agg(*(F.max(F.when(F.col("_w") == w, F.col("_c"))).alias(c) for w, c in zip(names, cells, strict=True)))
    kinds = at.groupBy(key, F.col("inserted").alias("added"), *cells).agg(F.count(F.lit(1)).alias("times"))
    told = lambda c: F.element_at(F.array(*map(F.lit, CATEGORIES)), F.col(c) % len(CATEGORIES) + 1)
    read = [F.when(F.col(c).isNotNull(), F.struct(F.lit(w).alias("w"), F.floor(F.col(c) / len(CATEGORIES)).alias("reading"), told(c).alias("category"))) for w, c in zip(names, cells, strict=True)]
    return kinds.select(key, "added", F.array_compact(F.array(*read)).alias("x"), "times")


def tallied_places(places: DataFrame, key: str, witness: str) -> tuple[DataFrame, DataFrame]:
    """Of alike_places(): what tallied() gives of rows by key, witness and category, and of meetings() by key and MET."""
    each = places.select(key, "times", F.explode("x").alias("x"))
    own = each.groupBy(key, F.col("x.w").alias(witness), F.col("x.category").alias("category")).agg(F.sum("times").alias("times"))
    left = places.where(F.size("x") > 1).select(key, "added", "times", "x", F.explode("x").alias("p"))
    pair = left.select(key, "added", "times", "p", F.explode("x").alias("q")).where("q.w > p.w")
    met = pair.select(key, "times", "added", F.col("p.w").alias("a"), F.col("q.w").alias("b"), (F.col("p.reading") == F.col("q.reading")).alias("same"), F.col("p.category").alias("category"), F.col("q.category").alias("other"))
    return own, met.groupBy(key, *MET).agg(F.sum("times").alias("times"))


def tallied(rows: DataFrame, *by: str) -> DataFrame:
    """Rows that agree in the columns of by as one, with their number: what shared_readings() and axis_similarity() take in the place of single rows."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("times"))


#: What is told apart of meetings.
MET = ["a", "b", "same", "category", "other", "added"]


def _counted(rows: DataFrame):
    """How many rows a condition holds for, single or tallied."""
    times = F.col("times") if "times" in rows.columns else F.lit(1)
    return lambda condition: F.sum(F.when(condition, times).otherwise(0).cast("long"))


def shared_readings(met: DataFrame) -> DataFrame:
    """A, b, errors, variants, gaps (omissions and additions) and combined: how many departures two witnesses share, over all texts."""
    times = _counted(met)
    n = lambda *c: times(F.col("same") & (F.col("category") == F.col("other")) & F.col("category").isin(*c))
    total = met.groupBy("a", "b").agg(n("error").alias("errors"), n("variant").alias("variants"), n("omission", "addition").alias("gaps"))
    return total.withColumn("combined", F.col("errors") + F.col("variants") + F.col("gaps")).where("combined > 0")


def axis_similarity(lengths: DataFrame, rows: DataFrame, met: DataFrame, key: str, witness: str, names: list[str], base_name: str) -> DataFrame:
    """F12 on the common axis: key, a < b and sim, twice the characters that two texts share at the same place over the characters of both (two empty texts: 1); the base is one of them. lengths: key, n (characters of the base)."""
    of_rows, of_met = _counted(rows), _counted(met)
    is_ = lambda c: of_rows(F.col("category") == c)
    by_name = lambda k, *v: F.map_from_entries(F.collect_list(F.struct(k.alias("k"), F.struct(*v).alias("v"))))
    pair_name = lambda a, b: F.concat_ws("\0", a, b)
    # all that is known of a text is one row, in maps of a few dozen witnesses and their pairs, so pairs meet it without a join
    own = rows.groupBy(key, F.col(witness).alias("w")).agg(is_("addition").alias("added"), is_("omission").alias("omitted"), of_rows(F.col("category") != "addition").alias("departed"))
    own = own.groupBy(key).agg(by_name(F.col("w"), "added", "omitted", "departed").alias("own"))
    shared = met.groupBy(key, "a", "b").agg(of_met(~F.col("added")).alias("both"), of_met(F.col("same") & (F.col("category") != "omission")).alias("alike"))
    shared = shared.groupBy(key).agg(by_name(pair_name("a", "b"), "both", "alike").alias("shared"))
    z = lambda c: F.coalesce(c, F.lit(0).cast("long"))

    def edition(name: str) -> Column:
        """Its departures and characters; the base departs nowhere."""
        v = None if name == base_name else F.try_element_at("own", F.lit(name))
        departed, size = (F.lit(0).cast("long"), F.col("n").cast("long")) if v is None else (z(v["departed"]), F.col("n") + z(v["added"]) - z(v["omitted"]))
        return F.struct(F.lit(name).alias("w"), departed.alias("d"), size.alias("s"))

    all_ = lengths.join(own, key, "left").join(shared, key, "left").select(key, "n", "shared", F.array(*map(edition, [base_name, *sorted(names)])).alias("e"))
    left = all_.select(key, "n", "shared", "e", F.posexplode("e").alias("i", "p"))
    two = left.select(key, "n", "shared", "i", "p", F.posexplode("e").alias("j", "q")).where("i < j")
    met_ = F.try_element_at("shared", pair_name("p.w", "q.w"))
    two = two.select(key, F.col("p.w").alias("a"), F.col("q.w").alias("b"), (F.col("n") - F.col("p.d") - F.col("q.d") + z(met_["both"]) + z(met_["alike"])).alias("m"), (F.col("p.s") + F.col("q.s")).alias("t"))
    return two.select(key, "a", "b", "m", "t", F.when(F.col("t") == 0, 1.0).otherwise(2 * F.col("m") / F.col("t")).alias("sim"))
