"""Sequence numbers of one stream, taken one at a time."""

from __future__ import annotations

import bisect

#: How far behind the highest number a gap stays open: beyond it a number is another turn of the 16-bit counter.
REACH = 65_536


class Sequence:
    """Counts of a stream, and the gaps that late packets may still fill: [first, last] pairs, in order."""

    def __init__(self, numbers: list[int] | None = None, gaps: list[int] | None = None) -> None:
        self.packets, self.lost, self.loss_events, self.longest_gap, self.reordered, self.refunded, self.ext, self.top = numbers or [0] * 8
        self.first, self.last = list((gaps or [])[::2]), list((gaps or [])[1::2])

    @classmethod
    def of(cls, state: tuple | None) -> Sequence:
        return cls(*state) if state else cls()

    def state(self) -> tuple[list[int], list[int]]:
        numbers = [self.packets, self.lost, self.loss_events, self.longest_gap, self.reordered, self.refunded, self.ext, self.top]
        return numbers, [x for pair in zip(self.first, self.last) for x in pair]

    def take(self, seq: int) -> None:
        if not self.packets:
            self.packets, self.ext, self.top = 1, seq, seq
            return
        self.packets += 1
        self.ext += (seq - self.ext + 32768) % 65536 - 32768
        if self.ext > self.top:
            gap = self.ext - self.top - 1
            if gap:
                self.lost, self.loss_events, self.longest_gap = self.lost + gap, self.loss_events + 1, max(self.longest_gap, gap)
                self.first.append(self.top + 1)
                self.last.append(self.ext - 1)
            self.top = self.ext
            while self.last and self.last[0] < self.top - REACH:
                del self.first[0], self.last[0]
        elif self.ext < self.top:
            self.reordered += 1
            self.fill(self.ext)

    def fill(self, ext: int) -> None:
        at = bisect.bisect_right(self.first, ext) - 1
        if at < 0 or self.last[at] < ext:
            return
        self.lost, self.refunded = self.lost - 1, self.refunded + 1
        a, b = self.first[at], self.last[at]
        parts = [(x, y) for x, y in ((a, ext - 1), (ext + 1, b)) if x <= y]
        self.first[at : at + 1], self.last[at : at + 1] = [x for x, _ in parts], [y for _, y in parts]
