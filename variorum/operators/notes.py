"""Decisions of an editor as notes in words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import notes as N
from .graph import cut

EVIDENCE = ["witnesses", "within", "other", "reason", "commentaries"]
#: What a note says, but for its number and place.
SAID = ["old", "new", "given", "selected", "base", *EVIDENCE, "remark", "uncertain"]
#: Different decisions that may be broadcast.
KINDS = 20_000


def worded(decisions: DataFrame) -> DataFrame:
    """The rows with category, action, sources and note.

    decisions: idx, pos (from 0), old, new, given (class of the variant table, or null), selected (edition), base (edition),
    arrays of evidence (witnesses, within, other, reason, commentaries), remark and uncertain. No shuffle of the rows: what
    is said is put into words once for each different decision, and joined; where decisions differ too much to be
    broadcast (counted), each row is worded by itself. Null texts and arrays are empty, a null `uncertain` is false;
    evidence of unknown names says nothing.
    """
    kinds = cut(decisions.select(*SAID).distinct())
    if kinds.limit(KINDS + 1).count() <= KINDS:
        told = said(kinds.select(*(F.col(c).alias(f"_{c}") for c in SAID), *SAID))
        raw = decisions.withColumnsRenamed({c: f"__{c}" for c in SAID})
        d = raw.join(F.broadcast(told), [F.col(f"__{c}").eqNullSafe(F.col(f"_{c}")) for c in SAID])
    else:
        d = said(decisions)
    note = F.concat(N.note_head(F.col("idx"), F.col("pos")), "_tail")
    return d.select(*decisions.columns, "category", "action", "sources", note.alias("note"))


def said(decisions: DataFrame) -> DataFrame:
    """The rows without nulls, with category, action, sources and _tail, the note behind its number and place."""
    text = {c: F.coalesce(c, F.lit("")) for c in ("old", "new", "selected", "base", "remark")}
    lists = {c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull()) for c in EVIDENCE}
    d = decisions.withColumns({**text, **lists, "uncertain": F.coalesce("uncertain", F.lit(False))})
    c = {n: F.col(n) for n in (*text, *EVIDENCE)}
    d = d.withColumn("category", N.note_category(F.col("given"), c["old"], c["new"]))
    d = d.withColumns({"action": N.note_action(F.col("category"), c["old"], c["new"], c["selected"], c["base"]), "sources": N.note_sources(c["selected"], c["base"], c["witnesses"])})
    why = N.note_explanation(F.col("category"), c["old"], c["new"], F.col("sources"), *(c[n] for n in EVIDENCE), c["remark"])
    return d.withColumn("_tail", N.note_tail(F.col("category"), F.col("action"), c["old"], c["new"], F.col("sources"), why, F.col("uncertain")))
