"""A spoken prompt that is put together piece by piece: an ordered log of additions, selections and deletions, folded by key."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructType

from folioforge.streaming import stateful

OUT = StructType().add("key", StringType()).add("sequence", LongType()).add("prompt", StringType()).add("n_pieces", LongType())


def edited(pieces: list[str], selected: int | None, action: str, text: str | None) -> tuple[list[str], int | None]:
    """Pieces and selection after an edit: ``add`` selects the new piece, ``left`` and ``right`` move, ``delete`` takes the selected or else the last."""
    if action == "add" and text:
        return [*pieces, text], len(pieces)
    if action == "left" and pieces:
        return pieces, len(pieces) - 1 if selected is None else max(0, selected - 1)
    if action == "right" and selected is not None:
        return pieces, min(selected + 1, len(pieces) - 1)
    if action == "delete" and pieces:
        at = len(pieces) - 1 if selected is None else selected
        left = pieces[:at] + pieces[at + 1 :]
        return left, None if selected is None or not left else min(selected, len(left) - 1)
    return pieces, selected


def assembled(log: DataFrame, idle_seconds: float = 600.0, immediate: bool = False) -> DataFrame:
    """(key, sequence, prompt, n_pieces) of logs (key, ord, action, text): a prompt at each ``enter`` that has pieces.

    Edits of a key are taken by ``ord``; what comes late is no edit. ``immediate``: each addition is a prompt at once. What
    is not entered at the end of a batch, or when a stream rests, is dropped.
    """

    def step(state: tuple, rows: Iterable[tuple]) -> tuple[list[tuple], tuple]:
        saved = json.loads(state[0]) if state[0] else {"pieces": [], "selected": None, "last": -1, "n": 0}
        out = []
        for order, action, text in rows:
            if order <= saved["last"]:
                continue
            saved["last"] = int(order)
            if action == "add" and text is not None:
                text = text.strip()
            saved["pieces"], saved["selected"] = edited(saved["pieces"], saved["selected"], action, text)
            if saved["pieces"] and (action == "enter" or (immediate and action == "add")):
                out.append((saved["n"], " ".join(saved["pieces"]), len(saved["pieces"])))
                saved |= {"pieces": [], "selected": None, "n": saved["n"] + 1}
        return out, (json.dumps(saved),)

    return stateful.folded(log, "key", "ord", ["ord", "action", "text"], OUT, "saved string", ("",), step, lambda state: [], idle_seconds)
