"""Splitting texts into pre-tokens, as arrays over code points.

Two fixed patterns are covered. Both are read off character classes and their
changes, so a whole slice of texts is split in a few array operations; each
pre-token comes with a 64-bit hash, which lets a slice's distinct ones be found
without making a string of every occurrence.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import tiktoken

from .hashing import long_hashes, mix, powers

OTHER, LETTER, NUMBER, SPACE, END = range(5)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Code points handled at a time; longer texts are cut where white space begins.
LIMIT = 1 << 20
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = re.compile(rf"(?<=[^{_WHITE}])[{_WHITE}]")


@cache
def classes() -> np.ndarray:
    """The class of every code point, as the tokenizer libraries' own patterns see it.

    Both libraries follow one version of Unicode, which is not Python's, so
    their classes are asked for: a pattern of one class leaves its characters.
    """
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype("<u4")
    every, ranks = points.tobytes().decode("utf-32-le"), {bytes([i]): i for i in range(256)}
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        found = bytes(tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(every)).decode()
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return out


@cache
def _codes() -> np.ndarray:
    return mix(np.arange(1, 0x110001, dtype=np.uint64))


def parts(texts: list[str], limit: int | None = None) -> list[list[tuple[int, str]]]:
    """(row, text) lists of about ``limit`` code points, in the order of rows; a longer text is cut before white space."""
    limit = limit or LIMIT
    out, now, total = [], [], 0
    for row, text in enumerate(texts):
        at = 0
        while len(text) - at > limit and (cut := _CUT.search(text, at + limit)):
            if now:
                out.append(now)
                now, total = [], 0
            out.append([(row, text[at : cut.start()])])
            at = cut.start()
        if total + len(text) - at > limit and now:
            out.append(now)
            now, total = [], 0
        now.append((row, text[at:]))
        total += len(text) - at
    return [*out, now] if now else out


def split(texts: list[str], spaced: bool) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined, and of each pre-token the start, end, hash and text's number.

    ``spaced``: a space belongs to the pre-token after it and numbers run on, as
    in the byte-level pattern; otherwise white space is dropped and each number
    character stands alone, as in the word pattern.
    """
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(x) + 1 for x in texts]) - 1
    kind = classes()[points]
    kind[ends] = END
    start = np.empty(len(kind), bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    if spaced:
        # the last white space before a word: a plain space joins the word, any other stands alone
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] <= NUMBER))
        start[last] = True
        start[last[points[last] == 0x20] + 1] = False
    else:
        start |= kind == NUMBER
    # a lone apostrophe at the start of a pre-token takes the letters of a contraction with it
    quote = np.flatnonzero((points == 39) & start)
    quote = quote[kind[quote + 1] == LETTER]
    one, two = points[quote + 1], points[np.minimum(quote + 2, len(points) - 1)]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    start[quote[short | long] + 1] = False
    start[quote[short] + 2] = True
    start[quote[long] + 3] = True
    start |= kind == END
    marks = np.flatnonzero(start)
    drop = kind[marks] == END
    if not spaced:
        drop |= kind[marks] == SPACE
    s, e = marks[:-1][~drop[:-1]], marks[1:][~drop[:-1]]
    prefix = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(_codes()[points] * powers(_BASE, len(points)), out=prefix[1:])
    hashed = mix((prefix[e] - prefix[s]) * powers(_INVERSE, len(points))[s])
    long_hashes(hashed, points, s, e)
    return joined, s, e, hashed, np.searchsorted(ends, s)


def distinct(joined: str, start: np.ndarray, end: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray]:
    """The distinct hashes, their strings, and for each pre-token its number among them."""
    keys, first, number = np.unique(hashed, return_index=True, return_inverse=True)
    return keys, [joined[a:z] for a, z in zip(start[first].tolist(), end[first].tolist(), strict=True)], number


def ragged(values: np.ndarray, offsets: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``values[offsets[i]:offsets[i + 1]]`` of the picked i, end to end, and their sizes."""
    sizes = (offsets[1:] - offsets[:-1])[pick]
    total = int(sizes.sum())
    begin = np.repeat(offsets[:-1][pick] - np.append(0, np.cumsum(sizes)[:-1]), sizes)
    return values[begin + np.arange(total)], sizes
