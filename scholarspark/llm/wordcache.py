"""A bounded memo for functions of words, in two generations so that common words survive when it fills."""

from __future__ import annotations

from collections.abc import Callable


class WordCache(dict):
    """``cache[word]`` is ``fn(word)``, computed on a miss; holds ``2 * limit`` words at most, and no long ones."""

    def __init__(self, fn: Callable, limit: int = 150_000, longest: int = 64):
        super().__init__()
        self.fn, self.limit, self.longest, self.old = fn, limit, longest, {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.fn(word)
        if len(word) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[word] = value
        return value
