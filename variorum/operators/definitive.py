"""the definitive text of punctuation: decisions between the marks of two texts, applied to the first."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: The marks that a place passes over, how far from its place a mark is looked for, and the sign for none.
DEFINITIVE_MARKS = "。，、；：？！\"（）《》【】「」『』．·…—─-－﹣:;,?!."
NEAR, NONE = 3, "∅"

_EDIT = ["pos", "id", "kind", "mark", "note"]
NOTE = StructType([StructField("pos", IntegerType()), StructField("original", StringType()), StructField("changed", StringType()), StructField("kind", StringType()), StructField("note", StringType())])
_DONE = pa.struct([("text", pa.string()), ("notes", pa.list_(pa.struct([("pos", pa.int32()), *((n, pa.string()) for n in NOTE.names[1:])]))), ("skipped", pa.int32())])
DONE = StructType([StructField("text", StringType()), StructField("notes", ArrayType(NOTE)), StructField("skipped", IntegerType())])


def applied(text: str, edits: list[dict], marks: frozenset) -> dict:
    """The text after edits that come from its end to its begin. One pointer walks back with them, so work grows with the text and not with the product; what an edit changes lies behind the pointer or a few marks before it."""
    out, notes, skipped = list(text), [], 0
    at, passed = len(out), sum(c not in marks for c in out)
    for e in edits:
        if e["kind"] not in ("added", "deleted", "replaced"):
            skipped += 1
            continue
        # the first place with pos characters before it, the end where there are fewer
        while at and (passed > e["pos"] or (passed == e["pos"] and out[at - 1] in marks)):
            at -= 1
            passed -= out[at] not in marks
        # a place beyond the characters is the very end, though the pointer went back for the marks there
        here = len(out) if passed < e["pos"] else at
        if e["kind"] == "added":
            if here < len(out):
                out[here + 1 : here + 1] = e["mark"]
                notes.append((e["pos"], NONE, e["mark"], "added", e["note"]))
            continue
        near = [here + k for k in (*range(NEAR + 1), *range(-1, -NEAR - 1, -1))]
        found = next((i for i in near if 0 <= i < len(out) and out[i] in marks), None)
        if found is None:
            continue
        new = "" if e["kind"] == "deleted" else e["mark"]
        notes.append((e["pos"], out[found], new or NONE, e["kind"], e["note"]))
        out[found : found + 1] = new
        if found < at:
            at += len(new) - 1
            passed += sum(c not in marks for c in new)
    notes.sort(key=lambda x: x[0])
    return {"text": "".join(out), "notes": [dict(zip(NOTE.names, n, strict=True)) for n in notes], "skipped": skipped}


def definitive(documents: DataFrame, differences: DataFrame, decisions: DataFrame, key: str, marks: str = DEFINITIVE_MARKS) -> DataFrame:
    """key, text, notes (by place), n_first and n_second (decisions for either text), n_applied and n_skipped.

    documents (key, text); differences (key, id, pos, kind, y): pos characters stand before the place, y are the marks of the
    second text; decisions (key, id, second, note): second tells whether its marks are taken. They are applied from the end.
    Marks that are added go behind the character at their place (behind a mark, where one stands there; at the end of the
    text nothing is added); for those deleted or replaced the nearest mark counts, three places on, then three back, and
    where there is none nothing happens. A decision without its difference is skipped; a null text is empty, a null note too.
    """
    d = decisions.select(key, "id", "second", F.coalesce("note", F.lit("")).alias("note"))
    taken = d.where("second").join(differences.select(key, "id", F.col("pos").cast("int").alias("pos"), "kind", F.coalesce("y", F.lit("")).alias("mark")), [key, "id"], "left")
    order = F.struct((-F.coalesce("pos", F.lit(0))).alias("back"), "id", *(c for c in _EDIT if c != "id"))
    edits = taken.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: F.struct(*(x[c].alias(c) for c in _EDIT))).alias("edits"), F.count(F.lit(1)).alias("n_second"))
    first = d.where("NOT second").groupBy(key).agg(F.count(F.lit(1)).alias("n_first"))
    rows = documents.select(key, F.coalesce("text", F.lit("")).alias("text")).join(edits, key, "left").join(first, key, "left")
    at, chosen = [rows.columns.index(c) for c in ("text", "edits")], frozenset(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, edits = (b.column(i).to_pylist() for i in at)
            done = [applied(t, e or [], chosen) for t, e in zip(text, edits, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(done, _DONE)], [*b.schema.names, "done"])

    x = rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("done", DONE)]))
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return x.select(key, "done.text", "done.notes", n("n_first"), n("n_second"), F.size("done.notes").cast("long").alias("n_applied"), F.col("done.skipped").cast("long").alias("n_skipped"))
