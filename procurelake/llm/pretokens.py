"""Pre-token boundaries of byte-level BPE, found with array operations instead of a regular expression.

Every code point gets a class from a table, refined by its next two neighbours (the last blank of a
run, an apostrophe that may open a contraction). What is left to know is a small state: the kind of
piece that is open. A class is thus a function from state to state, and functions compose
associatively, so the states of a whole batch of texts come from a two-level scan: all lanes
compose their own functions step by step side by side, the lanes' functions are then chained, and
a second sweep fills in the states. A piece starts where class and state before it say so.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

# Classes of a code point in its place. PAUSE stands between texts.
LETTER, NUMBER, OTHER, SPACE, BLANK, LAST_SPACE, LAST_BLANK, SHORT, LONG, PAUSE = range(10)
# States: the piece that is open after a code point; ONE and TWO: letters of a contraction to come.
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BLANKS, LEADING, ONE, TWO = range(8)
_APOSTROPHE, _SPACE = 0x27, 0x20
#: What the pattern's \s matches, and the letters after an apostrophe that it keeps together.
_BLANKS = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SHORT = "stmd"
#: Letters and numbers of Unicode 16 that the table in Python's library does not know yet.
_NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
_NEW_NUMBERS = [
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
    (0x1E5F1, 0x1E5FA),
]
_LONG = ("re", "ve", "ll")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            table[point] = LETTER
        elif kind == "N":
            table[point] = NUMBER
    for ranges, kind in ((_NEW_LETTERS, LETTER), (_NEW_NUMBERS, NUMBER)):
        for first, last in ranges:
            table[first : last + 1] = kind
    table[_BLANKS] = BLANK
    table[_SPACE] = SPACE
    return table


@lru_cache(maxsize=1)
def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a piece starts, by class and state."""
    step = np.zeros((10, 8), dtype=np.uint8)
    starts = np.ones((10, 8), dtype=bool)
    for kind, inside in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS), (SHORT, IN_OTHERS), (LONG, IN_OTHERS)):
        step[kind] = inside
        starts[kind, [inside, LEADING]] = False
    # an apostrophe opens a contraction unless it goes on with what is open
    for kind, left in ((SHORT, ONE), (LONG, TWO)):
        step[kind, [s for s in range(8) if s not in (IN_OTHERS, LEADING)]] = left
    for state, after in ((TWO, ONE), (ONE, FREE)):
        step[LETTER, state] = after
        starts[LETTER, state] = False
    for kind in (SPACE, BLANK):
        step[kind] = IN_BLANKS
        starts[kind, IN_BLANKS] = False
    step[LAST_SPACE] = LEADING
    step[LAST_BLANK] = FREE
    step[PAUSE] = FREE
    return step, starts


def _refined(points: np.ndarray) -> np.ndarray:
    """Class of each code point with its neighbours seen; ``points`` holds -1 between texts."""
    kinds = _classes()[np.maximum(points, 0)]
    kinds[points < 0] = PAUSE
    following = np.append(kinds[1:], PAUSE)
    last = (following != SPACE) & (following != BLANK) & (following != PAUSE)
    out = kinds.copy()
    out[(kinds == SPACE) & last] = LAST_SPACE
    out[(kinds == BLANK) & last] = LAST_BLANK
    marks = np.flatnonzero(points == _APOSTROPHE)
    if len(marks):
        padded = np.concatenate([points, [-1, -1]])
        one, two = padded[marks + 1], padded[marks + 2]
        out[marks[np.isin(one, [ord(c) for c in _SHORT])]] = SHORT
        for pair in _LONG:
            out[marks[(one == ord(pair[0])) & (two == ord(pair[1]))]] = LONG
    return out


def _states(kinds: np.ndarray) -> np.ndarray:
    """State before each code point, by composing the classes' functions in lanes."""
    step = _machine()[0]
    count = len(kinds)
    lanes = max(1, min(8192, int(np.sqrt(count))))
    width = -(-count // lanes)
    grid = np.full(lanes * width, PAUSE, dtype=np.uint8)
    grid[:count] = kinds
    grid = np.ascontiguousarray(grid.reshape(lanes, width).T)
    flat = step.ravel()
    whole = np.repeat(np.arange(8, dtype=np.uint8)[:, None], lanes, axis=1)  # the identity, for each lane
    for row in grid:
        whole = flat[row.astype(np.int16) * 8 + whole]
    entry = np.empty(lanes, dtype=np.uint8)
    state = FREE
    for lane in range(lanes):
        entry[lane] = state
        state = whole[state, lane]
    before = np.empty((width, lanes), dtype=np.uint8)
    for at, row in enumerate(grid):
        before[at] = entry
        entry = flat[row.astype(np.int16) * 8 + entry]
    return before.T.ravel()[:count]


def boundaries(texts: list[str]) -> list[np.ndarray]:
    """For each text the code point offsets at which its pieces start, and its length at the end."""
    joined = "".join(text + "\x00" for text in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.int32).copy()
    ends = np.cumsum([len(text) + 1 for text in texts], dtype=np.int64) - 1
    points[ends] = -1
    kinds = _refined(points)
    begins = _machine()[1][kinds, _states(kinds)]
    begins[ends] = True
    at = np.flatnonzero(begins)
    cuts = np.searchsorted(at, ends)
    first = np.concatenate([[0], cuts[:-1] + 1])
    origin = np.concatenate([[0], ends[:-1] + 1])
    return [at[a : b + 1] - o for a, b, o in zip(first, cuts, origin)]
