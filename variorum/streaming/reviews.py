"""M2: how well cards are known, from reviews in order: as one fold over a table, and as state on a stream.

A review moves a card's level by one up, by one down or not at all, and levels stay within bounds. Such a step, and any
sequence of them, is clamp(level + shift, low, high); so reviews of one card are put together in parts, wherever they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The highest level, difficulties from which on a right answer counts, to which it counts against, and the usual one.
HIGHEST, EASY, HARD, USUAL = 5, 4, 2, 3

PROGRESS = "card long, mastery long, times_reviewed long, times_correct long, last_reviewed timestamp"
_PART = "card long, first timestamp, first_id long, last timestamp, n long, correct long, low long, high long, shift long"


def step(correct: Column, difficulty: Column) -> Column:
    """What a review adds: a right answer to an easy card one, to a hard one (or a wrong answer) one less. Nulls: not correct, usual difficulty."""
    d = F.coalesce(difficulty, F.lit(USUAL))
    return F.when(~F.coalesce(correct, F.lit(False)) | (d <= HARD), -1).when(d >= EASY, 1).otherwise(0)


def put_together(card: np.ndarray, low: np.ndarray, high: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step for each run of equal cards: neighbours are put together two by two until no run has two."""
    while len(card) > 1:
        new = np.concatenate([[True], card[1:] != card[:-1]])
        begin = np.maximum.accumulate(np.where(new, np.arange(len(card)), 0))
        second = (np.arange(len(card)) - begin) % 2 == 1
        if not second.any():
            break
        two = np.flatnonzero(second)
        one = two - 1
        low[one], high[one] = (np.clip(x[one] + shift[two], low[two], high[two]) for x in (low, high))
        shift[one] += shift[two]
        card, low, high, shift = (x[~second] for x in (card, low, high, shift))
    return card, low, high, shift


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted reviews (card, ts, id, correct, step) of a partition as a row a card; what a batch ends with is held for the next."""
    names = ["card", "first", "first_id", "last", "n", "correct", "low", "high", "shift"]
    held: pd.DataFrame | None = None
    for b in batches:
        d = b.to_pandas()
        runs = d.groupby("card", sort=False).agg(first=("ts", "first"), first_id=("id", "first"), last=("ts", "last"), n=("ts", "size"), correct=("correct", "sum"))
        size = len(d)
        _, low, high, shift = put_together(d["card"].to_numpy(), np.zeros(size, np.int64), np.full(size, HIGHEST), d["step"].to_numpy().astype(np.int64))
        runs = runs.reset_index().assign(low=low, high=high, shift=shift)[names]
        if held is not None and len(runs) and held["card"].iloc[0] == runs["card"].iloc[0]:
            both = [np.array([x, y], np.int64) for x, y in zip(held.iloc[0][["card", "low", "high", "shift"]], runs.iloc[0][["card", "low", "high", "shift"]], strict=True)]
            _, low, high, shift = put_together(*both)
            for c, v in {"first": held["first"].iloc[0], "first_id": held["first_id"].iloc[0], "n": held["n"].iloc[0] + runs["n"].iloc[0], "correct": held["correct"].iloc[0] + runs["correct"].iloc[0], "low": low[0], "high": high[0], "shift": shift[0]}.items():
                runs.loc[0, c] = v
        elif held is not None and len(runs):
            yield pa.RecordBatch.from_pandas(held, _SCHEMA, preserve_index=False)
        if len(runs) > 1:
            yield pa.RecordBatch.from_pandas(runs.iloc[:-1], _SCHEMA, preserve_index=False)
        held = runs.iloc[-1:].reset_index(drop=True) if len(runs) else held
    if held is not None:
        yield pa.RecordBatch.from_pandas(held, _SCHEMA, preserve_index=False)


_TIME = pa.timestamp("us", "UTC")
_SCHEMA = pa.schema([("card", pa.int64()), ("first", _TIME), ("first_id", pa.int64()), ("last", _TIME), *((n, pa.int64()) for n in ("n", "correct", "low", "high", "shift"))])


def progress(reviews: DataFrame) -> DataFrame:
    """PROGRESS of reviews (card, ts, id, correct, difficulty), taken in the order of ts and id, from level 0. Reviews are sorted across partitions and put together in each, so a card with a third of all reviews is spread over many; a card then has at most a row a partition. Reviews without card or ts take no part."""
    r = reviews.where("card IS NOT NULL AND ts IS NOT NULL").select(F.col("card").cast("long").alias("card"), "ts", F.coalesce("id", F.lit(0)).cast("long").alias("id"), F.coalesce("correct", F.lit(False)).cast("int").alias("correct"), step(F.col("correct"), F.col("difficulty")).alias("step"))
    parts = r.repartitionByRange("card", "ts", "id").sortWithinPartitions("card", "ts", "id").mapInArrow(_parts, _PART)
    fold = F.aggregate(F.array_sort(F.collect_list(F.struct("first", "first_id", "low", "high", "shift"))), F.lit(0).cast("long"), lambda level, x: F.least(x["high"], F.greatest(x["low"], level + x["shift"])))
    return parts.groupBy("card").agg(fold.alias("mastery"), F.sum("n").alias("times_reviewed"), F.sum("correct").alias("times_correct"), F.max("last").alias("last_reviewed"))


class Reviews(StatefulProcessor):
    """A card's progress as a value, and its reviews that the watermark has not passed as a list: a timer takes them in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("progress", "mastery long, n long, correct long, last long")
        self.waiting = handle.getListState("waiting", "ts long, id long, correct int, step int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for d in rows:
            at = d["us"].astype("int64")
            self.waiting.appendList(list(zip(at.tolist(), d["id"].tolist(), d["correct"].tolist(), d["step"].tolist(), strict=True)))
            for ms in sorted(set((at // 1000 + 1).tolist())):
                self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        rows = sorted(tuple(r) for r in self.waiting.get())
        due = [r for r in rows if r[0] < now]
        if not due:
            return
        rest = rows[len(due) :]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        level, n, right, _ = self.known.get() if self.known.exists() else (0, 0, 0, 0)
        for *_, correct, by in due:
            level, n, right = min(HIGHEST, max(0, level + by)), n + 1, right + correct
        self.known.update((level, n, right, due[-1][0]))
        yield pd.DataFrame({"card": [key[0]], "mastery": [level], "times_reviewed": [n], "times_correct": [right], "last_reviewed": pd.to_datetime([due[-1][0]], unit="us", utc=True)})


def progress_stream(reviews: DataFrame, late: str = "10 minutes") -> DataFrame:
    """PROGRESS of a card whenever the watermark passes reviews of it, so the last row of a card is its progress; they count in the order of ts and id though they come in another, as long as they are not later than `late`. Needs the RocksDB state store; state is restored from the query's checkpoint."""
    r = reviews.where("card IS NOT NULL AND ts IS NOT NULL").select(F.col("card").cast("long").alias("card"), "ts", F.unix_micros("ts").alias("us"), F.coalesce("id", F.lit(0)).cast("long").alias("id"), F.coalesce("correct", F.lit(False)).cast("int").alias("correct"), step(F.col("correct"), F.col("difficulty")).alias("step"))
    return r.withWatermark("ts", late).groupBy("card").transformWithStateInPandas(Reviews(), PROGRESS, outputMode="append", timeMode="EventTime")
