"""Ropes: strings that are joined without being copied, and compared without being written out."""

from __future__ import annotations

_PRIME, _BASE = (1 << 61) - 1, 0x1F2E3D4C5B6A7988


class Rope:
    """A string as a leaf, or as two ropes. ``code`` is a polynomial hash, alike for equal strings however they were joined."""

    __slots__ = ("code", "left", "right", "size", "text")

    def __init__(self, text: str | None = None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if text is not None:
            self.size, self.code = len(text), 0
            for c in text:
                self.code = (self.code * _BASE + ord(c)) % _PRIME
        else:
            self.size = left.size + right.size
            self.code = (left.code * pow(_BASE, right.size, _PRIME) + right.code) % _PRIME

    def __add__(self, other: Rope) -> Rope:
        if not other.size:
            return self
        if not self.size:
            return other
        if self.text is not None and other.text is not None and self.size + other.size <= 32:
            return Rope(self.text + other.text)
        return Rope(None, self, other)

    def __lt__(self, other: Rope) -> bool:
        """Code point order. Parts of one size and one hash are passed over, so only the way to the first difference is walked."""
        ours, theirs = [self], [other]
        while ours and theirs:
            x, y = ours.pop(), theirs.pop()
            if x.size == y.size and x.code == y.code:
                continue
            if x.text is None and (y.text is not None or x.size >= y.size):
                ours += [x.right, x.left]
                theirs.append(y)
            elif y.text is None:
                theirs += [y.right, y.left]
                ours.append(x)
            else:
                n = min(x.size, y.size)
                if x.text[:n] != y.text[:n]:
                    return x.text[:n] < y.text[:n]
                if x.size > n:
                    ours.append(Rope(x.text[n:]))
                if y.size > n:
                    theirs.append(Rope(y.text[n:]))
        return bool(theirs)

    def __str__(self) -> str:
        parts, todo = [], [self]
        while todo:
            x = todo.pop()
            if x.text is None:
                todo += [x.right, x.left]
            else:
                parts.append(x.text)
        return "".join(parts)
