"""Phonetic codes of English words: words with equal codes count as spoken alike.

The code follows the published idea of metaphones (consonant classes, silent letters, vowels only at the start), as one
table of rules applied from left to right; it is a small helper for the words of an alignment.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: (what stands at the place, what must stand before, what must follow, code); the first that fits counts.
RULES = [
    (r"^(?:gn|kn|pn|ps|wr)", None, None, lambda m: {"gn": "N", "kn": "N", "pn": "N", "ps": "S", "wr": "R"}[m]),
    (r"^x", None, None, "S"),
    (r"^wh?[aeiouy]+", None, None, "A"),
    (r"^wh", None, None, "A"),
    (r"^[aeiouy]+", None, None, "A"),
    (r"[aeiouy]+", None, None, ""),
    (r"mb$", None, None, "M"),
    (r"sch", None, None, "SK"),
    (r"tch", None, None, "X"),
    (r"ch", None, r"[rl]", "K"),
    (r"ch", None, None, "X"),
    (r"ck", None, None, "K"),
    (r"cia", None, None, "X"),
    (r"sc", None, r"[iey]", "S"),
    (r"c", None, r"[iey]", "S"),
    (r"cc|c|q|k+", None, None, "K"),
    (r"dg", None, r"[iey]", "J"),
    (r"d[dt]?|t(?=h$)", None, None, "T"),
    (r"gh", r"[aeiou]", r"$", ""),
    (r"ght", None, None, "T"),
    (r"gh", r"[aeiou]", r"[^aeiouy]", ""),
    (r"gh", None, None, "K"),
    (r"gn", None, r"(?:ed)?$", "N"),
    (r"g", None, r"[iey]", "J"),
    (r"g+", None, None, "K"),
    (r"h", None, r"[aeiouy]", lambda m: "H"),
    (r"h", None, None, ""),
    (r"j", None, None, "J"),
    (r"ph|f+|v+", None, None, "F"),
    (r"p+|b+", None, None, "P"),
    (r"sh|si(?=[ao])", None, None, "X"),
    (r"ss|s|z+", None, None, "S"),
    (r"th", None, None, "0"),
    (r"ti(?=[ao])", None, None, "X"),
    (r"t+", None, None, "T"),
    (r"w", None, r"[aeiouy]", ""),
    (r"w", None, None, ""),
    (r"x", None, None, "KS"),
    (r"l+", None, None, "L"),
    (r"m+", None, None, "M"),
    (r"n+", None, None, "N"),
    (r"r+", None, None, "R"),
]
_COMPILED = [(re.compile(p), b and re.compile(b + "$"), a and re.compile(a), c) for p, b, a, c in RULES]


@lru_cache(maxsize=1 << 16)
def primary_code(word: str) -> str:
    """The code of a lower-case word; what the rules don't know stands for itself."""
    at, out = 0, []
    while at < len(word):
        for p, before, after, code in _COMPILED:
            m = p.match(word, at) if not p.pattern.startswith("^") or at == 0 else None
            if m and m.end() > at and (before is None or before.search(word[:at])) and (after is None or after.match(word, m.end())):
                out.append(code(m[0]) if callable(code) else code)
                at = m.end()
                break
        else:
            out.append(word[at] if not word[at] in "'-" else "")
            at += 1
    return "".join(out)
