"""Splitting of texts into pretokens by a deterministic machine that is run over chunks in parallel.

A pattern of the byte-level BPE family is compiled by hand into a machine over eight states and a few character classes.
What the pattern looks ahead for (the end of a run of spaces, a contraction) is put into the class of the character, so
the machine itself never looks ahead. Each chunk is run from all states at once, which gives its state map; the maps of
the chunks compose by a parallel prefix scan, which gives the state that each chunk really starts in; a second run marks
the places where a pretoken starts.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

# The white space that the pattern's \s means.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

OTHER, LETTER, NUMBER, SPACE, WHITESPACE, QUOTE, END = range(7)
# Symbols the machine reads.
(S_OTHER, S_LETTER, S_NUMBER, S_GLUE, S_LAST, S_RUN, S_QUOTE2, S_QUOTE3, S_END) = range(9)
# States: nothing open, an open run of one kind, a space that waits for its word, a run of white space, one or two
# letters of a contraction still to come.
START, IN_LETTER, IN_NUMBER, IN_OTHER, GLUED, IN_RUN, ONE_MORE, TWO_MORE = range(8)
STATES, CHUNK = 8, 256


@lru_cache(1)
def _classes() -> np.ndarray:
    kinds = np.zeros(sys.maxunicode + 1, np.uint8)
    for code in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(code))[0]
        kinds[code] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    kinds[WHITE] = WHITESPACE
    kinds[0x20] = SPACE
    kinds[0x27] = QUOTE
    return kinds


@lru_cache(2)
def _machine(spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Next state and start-of-pretoken mark by (symbol, state).

    ``spaced``: a space belongs to the word after it and numbers form runs; otherwise white space stands alone and every
    digit is a pretoken.
    """
    step, mark = np.zeros((9, STATES), np.uint8), np.ones((9, STATES), np.uint8)
    runs = {S_LETTER: IN_LETTER, S_NUMBER: IN_NUMBER, S_OTHER: IN_OTHER, S_QUOTE2: IN_OTHER, S_QUOTE3: IN_OTHER}
    for symbol, run in runs.items():
        step[symbol] = run
        mark[symbol, [run, GLUED]] = 0
    for symbol, rest in ((S_QUOTE2, ONE_MORE), (S_QUOTE3, TWO_MORE)):
        step[symbol] = rest
        step[symbol, [IN_OTHER, GLUED]] = IN_OTHER
    if not spaced:
        step[S_NUMBER], mark[S_NUMBER] = START, 1
    step[S_LETTER, ONE_MORE], step[S_LETTER, TWO_MORE] = START, ONE_MORE
    mark[S_LETTER, [ONE_MORE, TWO_MORE]] = 0
    step[S_GLUE] = GLUED if spaced else START
    step[S_LAST] = START
    step[S_RUN], mark[S_RUN, IN_RUN] = IN_RUN, 0
    step[S_END] = START
    return step.reshape(-1), mark.reshape(-1)


def _symbols(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    kinds = _classes()[codes]
    kinds[ends] = END
    codes = codes.copy()
    codes[ends] = 0
    after = np.append(kinds[1:], np.uint8(END))
    out = np.array([S_OTHER, S_LETTER, S_NUMBER, S_RUN, S_RUN, S_OTHER, S_END], np.uint8)[kinds]
    word_next = (after != SPACE) & (after != WHITESPACE) & (after != END)
    out[(kinds == SPACE) & word_next] = S_GLUE
    out[(kinds == WHITESPACE) & word_next] = S_LAST
    quotes = np.flatnonzero(kinds == QUOTE)
    if len(quotes):
        padded = np.append(codes, np.zeros(2, codes.dtype))
        one, two = padded[quotes + 1], padded[quotes + 2]
        out[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = S_QUOTE2
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        out[quotes[pair]] = S_QUOTE3
    return out


def _marks(symbols: np.ndarray, spaced: bool) -> np.ndarray:
    step, mark = _machine(spaced)
    n = len(symbols)
    rows = -(-n // CHUNK)
    grid = np.full(rows * CHUNK, S_END, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T) * np.uint8(STATES)
    # The map of each chunk: where each state leads.
    maps = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], rows, axis=1)
    for line in grid:
        maps = step[line + maps]
    # Inclusive prefix scan of the maps under composition.
    maps = np.ascontiguousarray(maps.T)
    reach = 1
    while reach < rows:
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.intp), axis=1)
        reach *= 2
    state = np.empty(rows, np.uint8)
    state[:1], state[1:] = START, maps[:-1, START]
    marks = np.empty((CHUNK, rows), np.uint8)
    for i, line in enumerate(grid):
        at = line + state
        marks[i] = mark[at]
        state = step[at]
    return marks.T.reshape(-1)[:n]


def pretokens(pieces: list[str], spaced: bool) -> tuple[list[str], np.ndarray]:
    """All pretokens of ``pieces`` in order, and the position in that list where each piece begins (and the end).

    Between two pieces the list holds one entry, a line feed, that belongs to neither.
    """
    joined = "\n".join(pieces) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(lengths + 1) - 1
    starts = np.flatnonzero(_marks(_symbols(codes, ends), spaced))
    places = starts.tolist()
    words = [joined[a:b] for a, b in zip(places, places[1:] + [len(joined)])]
    return words, np.append(0, np.searchsorted(starts, ends) + 1)


def sections(text: str, most: int = 1 << 20) -> Iterator[str]:
    """A very long text cut before single spaces that are followed by a word; every pattern starts a pretoken there."""
    while len(text) > most:
        at = text.rfind(" ", 1, most)
        while at > 0 and text[at + 1].isspace():
            at = text.rfind(" ", 1, at)
        if at <= 0:
            at = text.find(" ", most)
            while 0 < at < len(text) - 1 and text[at + 1].isspace():
                at = text.find(" ", at + 1)
            if at <= 0 or at == len(text) - 1:
                break
        yield text[:at]
        text = text[at:]
    yield text
