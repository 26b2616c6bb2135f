"""Risk history of conversations, as a stream: what a reader sees of a conversation when an answer arrives.

Turns go in (SCHEMA), a row per answer comes out (HISTORY): its number in the conversation, the question it answers, its risk,
and mean and largest risk so far. Risks are whole millionths, so sums are exact in any order. The state of a conversation is its last
turn, count, sum, peak and question, whatever its length.

Cases: turns of a micro-batch are taken by turn, then role (the question first), then risk; a turn that comes in a later
batch than one after it is not dropped: it is counted when it comes, and is marked as late. Turns behind the watermark are dropped by Spark. An answer
without risk is numbered, but is not in mean and peak. An answer before any question has a null question. Null conversations are one
conversation; null turns come first. A conversation that is idle for longer than `idle` is forgotten, and begins anew with its next turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "conv_id long, turn long, role string, label string, risk long, at timestamp"
HISTORY = "conv_id long, turn long, n long, question string, risk long, mean double, peak long, late boolean"
STATE = "turn long, n long, scored long, total long, peak long, question string"


def history(turns: DataFrame, late: str = "10 minutes", idle: int = 86_400) -> DataFrame:
    """HISTORY of a stream of turns. late: how far turns may lie behind the newest; idle: seconds after which a conversation is
    forgotten. A micro-batch's turns of one conversation meet in one task (without texts): the source's limits of files or bytes per
    batch bound them."""

    def go(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches))
        rows = rows.assign(answer=rows["role"].eq("assistant")).sort_values(["turn", "answer", "risk"], na_position="first", kind="stable")
        last, n, scored, total, peak, question = state.get if state.exists else (None, 0, 0, 0, None, None)
        out = []
        for turn, role, label, risk in zip(rows["turn"], rows["role"], rows["label"], rows["risk"], strict=True):
            turn, risk, label = (None if pd.isna(x) else x for x in (turn, risk, label))
            behind = last is not None and (turn is None or turn < last)
            if role == "user":
                question = label
            elif role == "assistant":
                n += 1
                if risk is not None:
                    scored, total, peak = scored + 1, total + int(risk), int(risk) if peak is None else max(peak, int(risk))
                out.append((key[0], turn, n, question, risk, total / scored if scored else None, peak, behind))
            if turn is not None and not behind:
                last = int(turn)
        state.update((last, n, scored, total, peak, question))
        newest = rows["at"].max()
        if not pd.isna(newest):
            state.setTimeoutTimestamp(max(int(newest.timestamp() * 1000), state.getCurrentWatermarkMs()) + idle * 1000)
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in HISTORY.split(", ")])
        yield frame.astype({"conv_id": "Int64", "turn": "Int64", "risk": "Int64", "peak": "Int64", "mean": "float64", "late": "bool"})

    rows = turns.select([f.split()[0] for f in SCHEMA.split(", ")]).withWatermark("at", late)
    return rows.groupBy("conv_id").applyInPandasWithState(go, HISTORY, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def millionths(risk: F.Column) -> F.Column:
    return F.floor(risk * 1_000_000).cast("long")
