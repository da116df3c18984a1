"""Undo and redo over an event log, replayed per session in order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

DEPTH = 20


def replay(log: DataFrame, depth: int = DEPTH) -> DataFrame:
    """After each event (session, seq, op, step): the step on top and the sizes of both stacks.

    'push' clears what could be redone; the undo stack holds ``depth`` entries. A session's log is one task's unit, as
    each event depends on all before it."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        undo, redo, out = [], [], []
        for r in pdf.sort_values("seq").itertuples():
            if r.op == "push":
                undo, redo = (undo + [r.step])[-depth:], []
            elif r.op == "undo" and undo:
                redo.append(undo.pop())
            elif r.op == "redo" and redo:
                undo.append(redo.pop())
            out.append((r.session, r.seq, undo[-1] if undo else None, len(undo), len(redo)))
        return pd.DataFrame(out, columns=["session", "seq", "top", "undo", "redo"])

    return log.groupBy("session").applyInPandas(fold, "session long, seq long, top string, undo int, redo int")
