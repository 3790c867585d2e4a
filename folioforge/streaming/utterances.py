"""Utterances from blocks of a microphone's samples: speech begins above a moving noise floor and ends with silence."""

from __future__ import annotations

import json
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StringType, StructType

from folioforge.streaming import stateful

#: The least level of speech, and how far above the noise it begins, above it and below its own peak it ends.
QUIET = 0.01
START_RATIO = 1.25
SILENCE_RATIO = 1.4
PEAK_RATIO = 0.6
#: Fixed values in seconds: silence that ends an utterance, its longest and least length, the noise window, what is kept
#: before speech, and the history that a quiet start needs.
SILENCE_S = 0.5
MOST_S = 8.0
LEAST_S = 1.5
NOISE_S = 6.0
PAD_S = 0.5
HISTORY_S = 0.3
OUT = StructType().add("stream", StringType()).add("first_block", LongType()).add("last_block", LongType()).add("n_samples", LongType()).add("flushed", BooleanType())


class Chunker:
    """The state of one stream: where its buffer begins, its length, and whether it holds speech."""

    def __init__(self, rate: int, block: int, saved: str | None = None):
        self.rate, self.keep, self.need = rate, max(1, int(NOISE_S * rate / block)), max(3, int(HISTORY_S * rate / block))
        self.s = json.loads(saved) if saved else {"blocks": [], "levels": [], "silence": 0, "speech": False, "peak": 0.0}

    def clear(self) -> None:
        self.s |= {"blocks": [], "silence": 0, "speech": False, "peak": 0.0}

    def _keep_last(self, samples: int) -> None:
        """The buffer's last samples only; blocks as [number, samples]."""
        out = []
        for number, n in reversed(self.s["blocks"]):
            if samples <= 0:
                break
            out.append([number, min(n, samples)])
            samples -= n
        self.s["blocks"] = out[::-1]

    def add(self, number: int, level: float, n: int) -> tuple[int, int, int] | None:
        """(first block, last block, samples) of an utterance that this block ends."""
        s = self.s
        s["blocks"].append([number, n])
        floor = max(1e-6, float(np.percentile(s["levels"], 20)) if s["levels"] else QUIET / START_RATIO)
        start = max(QUIET if len(s["levels"]) >= self.need else QUIET * START_RATIO, floor * START_RATIO)
        if not s["speech"] and level >= start:
            s["speech"], s["peak"] = True, level
            self._keep_last(int(PAD_S * self.rate))
        elif s["speech"]:
            s["peak"] = max(s["peak"], level)
        gate = max(QUIET, min(floor * SILENCE_RATIO, s["peak"] * PEAK_RATIO))
        if s["speech"]:
            s["silence"] = s["silence"] + n if level <= gate else 0
        size = sum(x for _, x in s["blocks"])
        done = None
        if s["speech"] and ((s["silence"] >= SILENCE_S * self.rate and size >= LEAST_S * self.rate) or size >= MOST_S * self.rate):
            done = self.flush()
        elif not s["speech"] and size >= MOST_S * self.rate:
            self._keep_last(int(PAD_S * self.rate))
        s["levels"] = [*s["levels"], level][-self.keep :]
        return done

    def flush(self) -> tuple[int, int, int] | None:
        b = self.s["blocks"]
        done = (b[0][0], b[-1][0], sum(x for _, x in b)) if b and self.s["speech"] else None
        self.clear()
        return done


def utterances(blocks: DataFrame, rate: int = 16000, block: int = 1024, idle_seconds: float = 2.0) -> DataFrame:
    """(stream, first_block, last_block, n_samples, flushed) of each utterance of blocks (stream, number, samples, control).

    control: null for sound; ``flush`` and ``pause`` drop the buffer and the noise history, ``end`` hands out what is left,
    as do the end of a batch and a stream that rests for ``idle_seconds``. Blocks of a stream are taken by number within a
    trigger. The state is the buffer's block numbers and six seconds of levels, never the samples.
    """

    def step(state: tuple, rows: Iterable[tuple]) -> tuple[list[tuple], tuple]:
        chunker, out = Chunker(rate, block, state[0] or None), []
        for number, samples, control in rows:
            if control in ("flush", "pause"):
                chunker.clear()
                chunker.s["levels"] = []
                continue
            found = chunker.flush() if control == "end" else chunker.add(int(number), float(np.sqrt(np.mean(np.square(samples)))) if len(samples) else 0.0, len(samples))
            if found:
                out.append((*found, control == "end"))
        return out, (json.dumps(chunker.s),)

    def end(state: tuple) -> list[tuple]:
        found = Chunker(rate, block, state[0] or None).flush()
        return [(*found, True)] if found else []

    return stateful.folded(blocks, "stream", "number", ["number", "samples", "control"], OUT, "saved string", ("",), step, end, idle_seconds)
