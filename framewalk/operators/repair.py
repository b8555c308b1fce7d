"""Repair of state sequences: gap filling and removal of short runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from framewalk.operators.contacts import RUNS, block_of, contact_frames, contact_runs, frame_type
from framewalk.operators.lags import in_runs
from framewalk.session import importable


def fill_gaps(states: np.ndarray, intermittency: int, upto: int | None = None) -> np.ndarray:
    """Sets what lies between equal values at most intermittency frames apart to that value.

    Frames (the first upto of them) are taken in order, and each value reaches to its last re-occurrence in its
    window; what is set counts as such for the later frames.
    """
    out = states.copy()
    for i in range(len(out) - 2 if upto is None else min(upto, len(out) - 2)):
        same = np.flatnonzero(out[i + 2 : i + intermittency + 2] == out[i])
        if same.size:
            out[i + 1 : i + 2 + same[-1]] = out[i]
    return out


def correct_intermittency(dtrj: DataFrame, intermittency: int) -> DataFrame:
    """(cmp, frame, state) with gaps of at most intermittency frames filled; frames must be dense.

    The rule is one of runs: a run reaches to the end of the last one in its chain, that is of the runs of its
    state that follow each other with gaps of at most intermittency frames.  Taken in order, the first run after the reach
    of the last taken is taken next.  Chains are a window by state; what is left of the order is one pass over
    runs that pass through Python sorted, which remembers one number.
    """
    if intermittency <= 0:
        return dtrj.select("cmp", "frame", "state")
    importable(dtrj.sparkSession)
    same = Window.partitionBy("cmp", "state").orderBy("t0")
    apart = F.coalesce((F.col("t0") - F.lag(F.col("t0") + F.col("len")).over(same) > intermittency).cast("int"), F.lit(0))
    chained = in_runs(dtrj, ["cmp", "state"]).withColumn("gap", apart).withColumn("chain", F.sum("gap").over(same.rowsBetween(Window.unboundedPreceding, 0)))
    reach = chained.withColumn("until", F.max(F.col("t0") + F.col("len") - 1).over(Window.partitionBy("cmp", "state", "chain"))).select("cmp", "state", "t0", "until")

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, end = object(), -1
        for batch in batches:
            keep = []
            for c, t0, until in zip(batch["cmp"].to_pylist(), batch["t0"].to_pylist(), batch["until"].to_pylist()):
                new = c != of
                if new or t0 > end:
                    of, end = c, until
                    keep.append(True)
                else:
                    keep.append(False)
            yield batch.filter(pa.array(keep, pa.bool_()))

    ordered = reach.repartition("cmp").sortWithinPartitions("cmp", "t0")
    kept = ordered.mapInArrow(taken, reach.schema)
    frame = dtrj.schema["frame"].dataType
    return kept.select("cmp", F.explode(F.sequence(F.col("t0"), F.col("until")).cast(ArrayType(frame))).alias("frame"), "state")


def correct_contact_intermittency(contacts: DataFrame, intermittency: int, n_frames: int) -> DataFrame:
    """contacts(frame, ref, sel) with gaps filled; contacts and their absence are treated alike, pair by pair.

    Of two states that take turns, a run longer than intermittency, or a pair's first or last one, begins what reaches up
    to the next such run of the other state: short runs in between are of the state before them.  So a pair is its runs and the gaps
    between them, in windows, and only the frames in contact are rows.
    """
    if intermittency <= 0:
        return contact_frames(contacts).select("frame", "ref", "sel")
    pair = [*block_of(contacts), "ref", "sel"]
    found = contact_runs(contacts)
    kind = frame_type(contacts)
    frames = lambda start, stop: F.explode(F.sequence(start, stop - 1).cast(ArrayType(kind))).alias("frame")
    several, alone = found, None
    if RUNS in found.columns:  # a single run needs no other row: it stays if it is long, or at the first or last frame
        several = found.where(F.col(RUNS) > 1)
        stays = (F.col("stop") - F.col("start") > intermittency) | (F.col("start") == 0) | (F.col("stop") == n_frames)
        alone = found.where((F.col(RUNS) == 1) & stays).select(frames(F.col("start"), F.col("stop")), "ref", "sel")
    w = Window.partitionBy(*pair).orderBy("t0")
    spans = several.select(*pair, F.col("start").alias("t0"), (F.col("stop") - F.col("start")).alias("len"))
    spans = spans.withColumns({"before": F.coalesce(F.lag(F.col("t0") + F.col("len")).over(w), F.lit(0)), "is_last": F.lead("t0").over(w).isNull(), "is_first": F.lag("t0").over(w).isNull()})
    end = F.col("t0") + F.col("len")
    turn = lambda bound, at, long: F.struct(F.lit(bound).alias("bound"), at.cast("long").alias("at"), long.alias("long"))
    gap = F.when(F.col("t0") > F.col("before"), turn(False, F.col("before"), F.col("is_first") | (F.col("t0") - F.col("before") > intermittency)))
    run = turn(True, F.col("t0"), (F.col("len") > intermittency) | (F.col("t0") == 0) | (end == n_frames))
    rest = F.when(F.col("is_last") & (end < n_frames), turn(False, end, F.lit(True)))
    turns = spans.select(*pair, F.explode(F.array_compact(F.array(gap, run, rest))).alias("e")).select(*pair, "e.*").where("long")
    by = Window.partitionBy(*pair).orderBy("at")
    changes = turns.withColumn("was", F.lag("bound").over(by)).where("was is null or was <> bound").withColumn("until", F.coalesce(F.lead("at").over(by), F.lit(n_frames)))
    filled = changes.where("bound").select(frames(F.col("at"), F.col("until")), "ref", "sel")
    return filled.unionByName(alone) if alone is not None else filled


def replace_short_sequences(dtrj: DataFrame, min_len: int, val: int = 0) -> DataFrame:
    """(cmp, frame, state) with runs of fewer than min_len frames set to val."""
    w = Window.partitionBy("cmp").orderBy("frame")
    changed = F.coalesce((F.col("state") != F.lag("state").over(w)).cast("int"), F.lit(0))
    numbered = dtrj.select("cmp", "frame", "state", changed.alias("c")).withColumn("run", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.count("*").over(Window.partitionBy("cmp", "run"))
    return numbered.select("cmp", "frame", F.when(size < min_len, F.lit(val)).otherwise(F.col("state")).cast(dtrj.schema["state"].dataType).alias("state"))


def replace_short_sequences_global(dtrj: DataFrame, min_len: int, val: int = 0) -> DataFrame:
    """As above, a value counting as present in a frame if any compound has it there.

    Presence is one row for each frame and value, so that the islands are made of a
    small table, which is joined back.
    """
    present = dtrj.select("frame", "state").distinct()
    island = F.col("frame") - F.row_number().over(Window.partitionBy("state").orderBy("frame"))
    islands = present.withColumn("island", island)
    short = islands.withColumn("n", F.count("*").over(Window.partitionBy("state", "island"))).where(F.col("n") < min_len).select("frame", "state", F.lit(True).alias("short"))
    joined = dtrj.join(short, ["frame", "state"], "left")
    return joined.select("cmp", "frame", F.when(F.col("short"), F.lit(val)).otherwise(F.col("state")).cast(dtrj.schema["state"].dataType).alias("state"))
