"""State of typing sessions: what each key event sets, and the state behind it.

Events: (session_id, seq, kind, composing, menu, full_roman, has_code, text). kind: letter, shift_letter, tab, space, select, escape, return, bracket, backslash, nav, digit, punct, apostrophe, release or other; text: the candidate or the punctuation at hand.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import text as T

#: The state before the first event.
CAPITALISE, SELECTING, LAST = True, False, None
_STATE = ("capitalise_next", "selecting", "last_text")


def transitions(events: DataFrame) -> DataFrame:
    """events with what each sets: set_caps and set_mode (null: unchanged), set_last (null: unchanged; empty: forgotten).

    A capital is due at the start, behind the end of a sentence and where a capital letter starts a composition, until a romanisation is committed. Tab in a menu starts selecting, and all keys but those of navigation end it. The last text is a committed single character, which an apostrophe that finds its code, or another key outside of a composition, uses up.
    """
    kind, composing, full = F.col("kind"), F.col("composing"), F.col("full_roman")
    commits = kind.isin("space", "select") & composing & F.col("menu")
    ends = T.ends_sentence(F.col("text"))
    caps = (
        F.when((kind == "shift_letter") & ~composing, F.lit(True))
        .when(commits & full, F.lit(False))
        .when((kind == "punct") & full & (composing | ends), ends)
    )
    mode = F.when(kind == "release", F.lit(None)).when((kind == "tab") & F.col("menu"), F.lit(True)).when(~composing, F.lit(False)).when(~kind.isin("nav", "tab"), F.lit(False))
    idle = ~composing & ~F.col("menu")
    last = (
        F.when(kind == "release", F.lit(None))
        .when(commits, F.when(F.length("text") == 1, F.col("text")).otherwise(F.lit("")))
        .when(idle & (kind == "apostrophe"), F.when(F.col("has_code"), F.lit("")))
        .when(idle & (kind != "shift_letter") & ~((kind == "punct") & full), F.lit(""))
    )
    return events.withColumns({"set_caps": caps, "set_mode": mode, "set_last": last})


def session_states(events: DataFrame) -> DataFrame:
    """events with the state behind each: capitalise_next, selecting, last_text. The last setting holds, which a window finds; sessions spread over tasks."""
    w = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = lambda c: F.last(c, ignorenulls=True).over(w)
    rows = transitions(events)
    rows = rows.withColumns({"capitalise_next": F.coalesce(held("set_caps"), F.lit(CAPITALISE)), "selecting": F.coalesce(held("set_mode"), F.lit(SELECTING)), "last_text": F.nullif(held("set_last"), F.lit(""))})
    return rows.drop("set_caps", "set_mode", "set_last")


def session_stream(events: DataFrame) -> DataFrame:
    """(session_id, seq, capitalise_next, selecting, last_text) of a stream of events, which come in order of seq within each micro-batch's session; the state is kept by session between micro-batches."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        caps, mode, last = state.get if state.exists else (CAPITALISE, SELECTING, LAST)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, set_caps, set_mode, set_last in zip(rows["seq"], rows["set_caps"], rows["set_mode"], rows["set_last"], strict=True):
            caps = caps if pd.isna(set_caps) else bool(set_caps)
            mode = mode if pd.isna(set_mode) else bool(set_mode)
            last = last if pd.isna(set_last) else set_last or None
            out.append((key[0], seq, caps, mode, last))
        state.update((caps, mode, last))
        yield pd.DataFrame(out, columns=["session_id", "seq", *_STATE])

    slim = transitions(events).select("session_id", "seq", "set_caps", "set_mode", "set_last")
    return slim.groupBy("session_id").applyInPandasWithState(fold, "session_id long, seq long, capitalise_next boolean, selecting boolean, last_text string", "caps boolean, mode boolean, last string", "append", "NoTimeout")
