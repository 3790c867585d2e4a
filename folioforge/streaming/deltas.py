"""Text that arrives in pieces, handed out in sentences; samples that arrive in pieces, handed out in blocks."""

from __future__ import annotations

import re
from collections.abc import Iterable

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from folioforge.operators.segmentation import sentences, split_sentences
from folioforge.streaming import stateful

#: Fixed value: words that the first piece handed out must have.
FIRST_WORDS = 5
#: Signs at which a sentence, and a phrase, may end or be held; what is more than blanks and punctuation.
_SENTENCE_SIGN, _PHRASE_SIGN = re.compile(r"[.!?…\n\"“”]"), re.compile(r"[.!?…\n\"“”,;:–—)]")
_SOLID = regex.compile(r"[^\s\p{P}$+<=>^`|~]")
_PHRASE = regex.compile(r"[\"”,;:] \s*|[–—)]\s*")


def complete_sentences(text: Column, language: Column | None = None) -> Column:
    """All sentences of a text but the last, which may go on."""
    s = sentences(text, language)
    return F.when(F.size(s) > 1, F.slice(s, F.lit(1), F.size(s) - 1)).otherwise(F.slice(s, 1, 0))


def stable_preview(text: Column, language: Column | None = None) -> Column:
    """What a growing text shows before its last sentence is over."""
    return F.array_join(complete_sentences(text, language), "")


def take_complete(buffer: str, first: bool, language: str = "en") -> tuple[list[str], str]:
    """(pieces to hand out, what is held).

    All complete sentences go, each a piece, told apart by the rule of ``sentences``; as the very first piece only as many
    together as have five words, else the shortest run of phrases that has them and leaves something.
    """
    found = split_sentences(buffer, language)
    if len(found) > 1 and not first:
        return found[:-1], found[-1]
    if first:
        for k in range(1, len(found)):
            if len("".join(found[:k]).split()) >= FIRST_WORDS:
                return ["".join(found[:k]), *found[k:-1]], found[-1]
        for m in _PHRASE.finditer(buffer):
            if len(buffer[: m.end()].split()) >= FIRST_WORDS and buffer[m.end() :].strip():
                return [buffer[: m.end()]], buffer[m.end() :]
    return [], buffer


def _reason(piece: str) -> str:
    """Phrase, sentence or paragraph, by how a piece ends."""
    bare = piece.rstrip()
    return "p" if "\n" in piece[len(bare) :] else "s" if regex.search(r"[.!?…][\"”’)]*$", bare) else "is"


PIECES = StructType().add("key", StringType()).add("sequence", LongType()).add("piece", StringType()).add("reason", StringType())


def folded(deltas: DataFrame, key: str = "key", order: str = "ord", text: str = "text", generation: str = "generation", language: str = "en", idle_seconds: float = 30.0) -> DataFrame:
    """(key, sequence, piece, reason) of growing texts (key, ord, text, generation, last boolean), in a batch or a stream.

    Rows of an older generation than the latest seen are dropped, and a newer one drops what is held; the last delta
    hands out the rest, as does the end of the batch or a stream that rests for ``idle_seconds``.
    """

    signed = lambda t, first: bool((_PHRASE_SIGN if first else _SENTENCE_SIGN).search(t))

    def step(state: tuple, rows: Iterable[tuple]) -> tuple[list[tuple], tuple]:
        held, first, now, n = state
        out: list[tuple] = []
        may_end = signed(held, first)
        for t, g, last in rows:
            if g < now:
                continue
            if g > now:
                held, first, now, may_end = "", True, int(g), False
            held += t or ""
            may_end = may_end or signed(t or "", first)
            if not (may_end or last):
                continue
            pieces, held = take_complete(held, first, language)
            before = first
            if last and held:
                pieces, held = [*pieces, held], ""
            out += [(n + k, p, _reason(p)) for k, p in enumerate(pieces)]
            n, first = n + len(pieces), bool(last) or (first and not pieces)
            # what was searched in vain ends at no later word, once one follows its last sign
            may_end = signed(held, first) and (bool(pieces) or first != before or not _SOLID.search(_PHRASE_SIGN.split(held)[-1]))
        return out, (held, bool(first), now, n)

    end = lambda state: [(state[3], state[0], _reason(state[0]))] if state[0] else []
    return stateful.folded(deltas.withColumnRenamed(key, "key"), "key", order, [text, generation, "last"], PIECES, "held string, first boolean, generation long, n long", ("", True, 0, 0), step, end, idle_seconds)


BLOCKS = StructType().add("key", StringType()).add("sequence", LongType()).add("start_sample", LongType()).add("n_samples", LongType()).add("rate", LongType())
#: Fixed value: seconds without samples after which a short block goes out.
IDLE_S = 0.2


def blocks(pieces: DataFrame, size: int = 24000, idle_seconds: float = IDLE_S) -> DataFrame:
    """(key, sequence, start_sample, n_samples, rate) of streams of (key, ord, n_samples, rate), handed out by ``size`` samples.

    What is there goes out, too, before another rate, at a row without samples (an idle mark), at the end of a batch, and
    when a stream rests for ``idle_seconds``.
    """

    def step(state: tuple, rows: Iterable[tuple]) -> tuple[list[tuple], tuple]:
        held, rate, sequence, at = state
        out: list[tuple] = []
        for n, r in rows:
            if held and (n == 0 or r != rate):
                out.append((sequence, at, held, rate))
                sequence, at, held = sequence + 1, at + held, 0
            rate = int(r) if n else rate
            held += int(n)
            while held >= size:
                out.append((sequence, at, size, rate))
                sequence, at, held = sequence + 1, at + size, held - size
        return out, (held, rate, sequence, at)

    end = lambda state: [(state[2], state[3], state[0], state[1])] if state[0] else []
    return stateful.folded(pieces, "key", "ord", ["n_samples", "rate"], BLOCKS, "held long, rate long, sequence long, at long", (0, 0, 0, 0), step, end, idle_seconds)
