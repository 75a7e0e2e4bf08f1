"""A transducer over the bytes of a word whose transitions carry how many tokens they add.

The state after some bytes is what the merges make of them; the transition on one more byte carries the number of tokens
of the longer prefix less that of the shorter one, which may be negative. Along a word the numbers sum up to its tokens,
whatever later bytes merge. States are made when they are first reached.

A new state follows from its last token alone: of the tokens that the prefix ends in, exactly one stays apart from the
last token of the prefix before it. Whether two tokens stay apart is read off the merges that made them: while both grow,
the parts at the border may merge with each other before one of them merges away from it.
"""

from __future__ import annotations

from functools import lru_cache

from geoscore.llm.bpe import NONE, SHORT, Vocabulary, vocabulary

KEPT_STATES = 2_000_000  # states that a task remembers


class Machine:
    def __init__(self, book: Vocabulary):
        self.book = book
        special = set(book.special.values())
        self.token_of = {text: i for i, text in enumerate(book.text_of) if text and i not in special}
        # Only these lengths are looked up for a prefix that ends in a byte.
        lengths: list[set[int]] = [set() for _ in range(256)]
        for text in self.token_of:
            lengths[text[-1]].add(len(text))
        self.lengths = [sorted(x, reverse=True) for x in lengths]
        self.grown: dict[int, tuple[list[tuple[int, int]], list[tuple[int, int]]] | None] = {}
        self.kept_apart: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        self.next: dict[int, int] = {}
        self.added, self.count, self.last = [0], [0], [-1]

    def _sides(self, token: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]] | None:
        """The first and the last part of a token while it is merged, each with the rank at which it merges on.

        None for a token that its own bytes do not merge to.
        """
        if token not in self.grown:
            book = self.book
            parts = [book.of_byte[b] for b in book.text_of[token]]
            first, last = [(parts[0], NONE)], [(parts[-1], NONE)]
            while len(parts) > 1:
                rank, i = min((book.ranks.get(a * book.base + b, NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if rank == NONE:
                    break
                for side, at in ((first, 0), (last, len(parts) - 2)):
                    if i == at:
                        side[-1] = (side[-1][0], rank)
                        side.append((book.made[rank], NONE))
                parts[i : i + 2] = [book.made[rank]]
            self.grown[token] = (first, last) if parts == [token] else None
        return self.grown[token]

    def _apart(self, left: int, right: int) -> bool:
        """Whether two adjacent tokens stay two when their bytes are merged from the start."""
        key = left * self.book.base + right
        if key not in self.kept_apart:
            a_parts, b_parts = self._sides(left)[1], self._sides(right)[0]
            i = j = 0
            while True:
                (a, a_on), (b, b_on) = a_parts[i], b_parts[j]
                rank = self.book.ranks.get(a * self.book.base + b, NONE)
                # Of equal ranks the merge farther to the left goes first.
                if rank < a_on and rank <= b_on and rank != NONE:
                    self.kept_apart[key] = False
                    break
                if a_on == b_on == NONE:
                    self.kept_apart[key] = True
                    break
                if a_on <= b_on:
                    i += 1
                else:
                    j += 1
        return self.kept_apart[key]

    def _step(self, prefix: bytes, count: list[int], last: list[int], trail: list[int]) -> tuple[int, int]:
        """Tokens and last token of a prefix; ``trail`` holds the states of the shorter ones."""
        n = len(prefix)
        for size in self.lengths[prefix[-1]]:
            if size > n:
                continue
            token = self.token_of.get(prefix[n - size :])
            if token is None or self._sides(token) is None:
                continue
            before = trail[n - size]
            if size == n or self._apart(last[before], token):
                return count[before] + 1, token
        raise ValueError("no token ends here")

    def tokens(self, word: str) -> int:
        """The sum of what the transitions along a word add."""
        text = word.encode()
        if len(text) > SHORT:
            return self._long(text)
        state, total, trail = 0, 0, [0]
        for i, byte in enumerate(text):
            key = state << 8 | byte
            state = self.next.get(key)
            if state is None:
                count, last = self._step(text[: i + 1], self.count, self.last, trail)
                state = self.next[key] = len(self.count)
                self.added.append(count - self.count[trail[-1]])
                self.count.append(count)
                self.last.append(last)
            total += self.added[state]
            trail.append(state)
        return total

    def _long(self, text: bytes) -> int:
        """The same for a long word, whose states are not kept."""
        longest = max(x[0] for x in self.lengths if x)
        count, last = [0], [-1]
        for i in range(len(text)):
            # Positions are counted from a window's start, so that no prefix is copied whole.
            low = max(0, i + 1 - longest)
            window = text[low : i + 1]
            for size in self.lengths[text[i]]:
                token = self.token_of.get(window[-size:]) if size <= len(window) else None
                if token is None or self._sides(token) is None:
                    continue
                if size == i + 1 or self._apart(last[i + 1 - size], token):
                    count.append(count[i + 1 - size] + 1)
                    last.append(token)
                    break
        return count[-1]

    def trim(self) -> None:
        if len(self.count) > KEPT_STATES:
            self.clear()


@lru_cache(4)
def machine(path: str) -> Machine:
    return Machine(vocabulary(path))
