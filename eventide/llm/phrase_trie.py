"""A double-array trie over phrases of word codes, advanced for all positions of a token array at once."""

from __future__ import annotations

import numpy as np

#: Places that are tried for a node with several children, in a window of this many, before it goes behind all others.
TRIES = 48
WINDOW = 4096


class PhraseTrie:
    """Accepts the rows of ``phrases`` (an array of codes above 0, one phrase of equal length per row, all different).

    Codes are numbered anew inside the trie, and a number is two symbols, so that no node has more children than the root of the number of
    words and the arrays stay dense. A symbol at the root leads to the state of its own value; from state ``s`` the symbol ``c`` leads to
    ``base[s] + c`` if ``check`` there says ``s``. State 0 is the dead one, and the symbol 0 stands for every other word and for breaks.
    """

    def __init__(self, phrases: np.ndarray, ids: np.ndarray):
        self.length = phrases.shape[1]
        self.alphabet, numbers = np.unique(phrases, return_inverse=True)
        self.digits = int(np.ceil(np.sqrt(len(self.alphabet)))) + 1
        order = np.lexsort(numbers.reshape(phrases.shape).T[::-1])
        numbers, ids = numbers.reshape(phrases.shape)[order], np.asarray(ids)[order]
        symbols = np.stack([numbers // self.digits + 1, numbers % self.digits + 1], axis=2).reshape(len(numbers), -1)
        self._span = self.digits + 2
        self.base, self.check = np.zeros(2 * self._span, np.int32), np.full(2 * self._span, -1, np.int32)
        self.check[: self._span] = 0
        self._last = self._low = self._span
        states = symbols[:, 0].astype(np.int64)
        for depth in range(1, symbols.shape[1]):
            pairs, back = np.unique(states << 32 | symbols[:, depth], return_inverse=True)
            states = self._place(pairs >> 32, pairs & 0xFFFFFFFF)[back.ravel()]
        size = self._last + self._span + 1
        self.base, self.check = self._fit(self.base, size, 0), self._fit(self.check, size, -1)
        self.accepted = np.full(size, -1, np.int64)
        self.accepted[states] = ids
        self.states, self.ids = states, ids

    @staticmethod
    def _fit(array: np.ndarray, size: int, fill: int) -> np.ndarray:
        return np.concatenate([array[:size], np.full(max(0, size - len(array)), fill, np.int32)])

    def _room(self, size: int) -> None:
        if size > len(self.check):
            size = max(size, len(self.check) * 3 // 2)
            self.base, self.check = self._fit(self.base, size, 0), self._fit(self.check, size, -1)

    def _base_for(self, own: np.ndarray) -> int:
        """A base at which all children ``own`` find a free place."""
        free = np.flatnonzero(self.check[self._low : min(self._low + WINDOW, self._last)] == -1)
        for place in free[:TRIES] + self._low:
            if (self.check[place - own[0] + own] == -1).all():
                return int(place - own[0])
        if len(free) > TRIES:
            self._low += int(free[TRIES // 2])
        elif self._low + WINDOW < self._last:
            self._low += WINDOW
        return int(self._last - own[0])

    def _place(self, parents: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """States for the children ``symbols`` of ``parents``, sorted by parent."""
        starts = np.flatnonzero(np.diff(parents, prepend=-1))
        counts = np.diff(np.append(starts, len(parents)))
        states = np.zeros(len(parents), np.int64)
        several = np.flatnonzero(counts > 1)
        for g in several[np.argsort(-counts[several], kind="stable")]:
            own = symbols[starts[g] : starts[g] + counts[g]]
            self._room(self._last + 2 * self._span)
            base = self._base_for(own)
            places = base + own
            self.base[parents[starts[g]]], self.check[places] = base, parents[starts[g]]
            states[starts[g] : starts[g] + counts[g]] = places
            self._last = max(self._last, int(places[-1]) + 1)
        at = starts[counts == 1]
        if len(at):
            # Any free place will do for an only child: the base is the place less its symbol.
            self._room(self._last + len(at) + 2 * self._span)
            places = np.flatnonzero(self.check[self._span : self._last + len(at)] == -1)[: len(at)] + self._span
            self.base[parents[at]], self.check[places], states[at] = places - symbols[at], parents[at], places
            self._last = max(self._last, int(places[-1]) + 1)
        return states

    def symbols(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both symbols of each token; 0 for words that stand in no phrase."""
        at = np.minimum(np.searchsorted(self.alphabet, tokens), len(self.alphabet) - 1)
        known = self.alphabet[at] == tokens
        return np.where(known, at // self.digits + 1, 0), np.where(known, at % self.digits + 1, 0)

    def ends(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions where a phrase begins, and the accepting states there."""
        pair = self.symbols(tokens)
        at = np.flatnonzero(pair[0][: max(len(tokens) - self.length + 1, 0)])
        states = pair[0][at]
        for depth in range(1, 2 * self.length):
            symbol = pair[depth % 2][at + depth // 2]
            following = self.base[states] + symbol
            alive = (symbol > 0) & (self.check[following] == states)
            at, states = at[alive], following[alive]
        return at, states
