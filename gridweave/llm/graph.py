"""Connected components of an edge table by contraction."""

from __future__ import annotations

from ..operators.graph import components

__all__ = ["Sets", "components"]


class Sets:
    """Union-find over 0 .. n - 1 with the least member as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True
