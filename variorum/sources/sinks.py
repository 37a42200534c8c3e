"""Renderers of notes and trees. Rows become lines by expressions; only a tree of a few leaves is put together on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import latex_escape


def markdown_cell(x: Column) -> Column:
    return F.when(F.length(x) == 0, "—").otherwise(F.replace(F.replace(x, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))


def markdown(notes: DataFrame) -> DataFrame:
    """B2: a line a note (index, position, note_type, base_text, variant_text)."""
    cells = [F.col("index").cast("string"), F.col("position").cast("string"), F.col("note_type"), F.col("base_text"), F.col("variant_text")]
    return notes.select("index", F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(F.coalesce(c, F.lit(""))) for c in cells]), F.lit(" |")).alias("line"))


def latex(notes: DataFrame) -> DataFrame:
    """B2: an apparatus entry a note; an empty lemma is an omission."""
    lemma = F.when(F.length("base_text") == 0, F.lit(r"\emph{om.}")).otherwise(latex_escape(F.col("base_text")))
    entry = F.concat(F.lit(r"\edtext{"), lemma, F.lit(r"}{\Afootnote{"), latex_escape(F.col("variant_text")), F.lit("}}"))
    return notes.select("index", entry.alias("line"))


def csv(notes: DataFrame, path: str) -> None:
    notes.write.option("header", "true").option("quoteAll", "true").mode("overwrite").csv(path)


def tei(notes: DataFrame) -> DataFrame:
    """An app element a note."""
    esc = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    app = F.concat(F.lit('<app n="'), F.col("index").cast("string"), F.lit('"><lem>'), esc(F.col("base_text")), F.lit("</lem><rdg>"), esc(F.col("variant_text")), F.lit("</rdg></app>"))
    return notes.select("index", app.alias("line"))


def newick(merges: list[tuple[int, int, float]], names: dict[int, str]) -> str:
    """A tree of the merges (a, b, height) of a clustering; labels with other than letters and digits are quoted."""
    quote = lambda s: s if s.isalnum() else "'" + s.replace("'", "''") + "'"
    tree, height = {k: quote(v) for k, v in names.items()}, dict.fromkeys(names, 0.0)
    for a, b, h in merges:
        tree[a] = f"({tree[a]}:{h / 2 - height[a]:.6f},{tree.pop(b)}:{h / 2 - height[b]:.6f})"
        height[a] = h / 2
    return "".join(tree.values()) + ";"


def nexus(merges: list[tuple[int, int, float]], names: dict[int, str]) -> str:
    """Taxa and the tree."""
    taxa = " ".join(f"'{n}'" for n in names.values())
    return f"#NEXUS\nBEGIN TAXA;\n  DIMENSIONS NTAX={len(names)};\n  TAXLABELS {taxa};\nEND;\nBEGIN TREES;\n  TREE t = {newick(merges, names)}\nEND;\n"
