"""Poses that jump off a camera's path, session by session."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Greatest step against the median, share of a session's frames that may go, and the step below which a camera stands still.
RATIO, BUDGET, STILL = 8.0, 0.1, 1e-9


class Path:
    """A session's frames as a linked list, with its steps (length per frame of the gap) in order of size."""

    def __init__(self, frames: list, centres: np.ndarray):
        self.frames, self.centres, n = frames, centres, len(frames)
        self.before, self.after = list(range(-1, n - 1)), [*range(1, n), -1]
        self.steps = {i: self._step(i, i + 1) for i in range(n - 1)}  # by the frame they start from
        self.sizes = sorted(self.steps.values())

    def _step(self, a: int, b: int) -> float:
        gap = max(1, self.frames[b] - self.frames[a]) if self.frames[a] is not None and self.frames[b] is not None else 1
        return float(np.linalg.norm(self.centres[b] - self.centres[a])) / gap

    def _without(self, i: int) -> tuple[list[float], float | None]:
        """Steps that go with a frame, and the one that comes."""
        a, b = self.before[i], self.after[i]
        return [self.steps[k] for k in (a, i) if k in self.steps], self._step(a, b) if a >= 0 and b >= 0 else None

    def ratio(self, but: int | None = None) -> float:
        """Greatest step against the median of those that move; infinite if none does.  but: as if that frame were gone."""
        gone, new = self._without(but) if but is not None else ([], None)
        for s in gone:
            del self.sizes[bisect_left(self.sizes, s)]
        if new is not None:
            insort(self.sizes, new)
        moving = bisect_right(self.sizes, STILL)
        n = len(self.sizes) - moving
        middle = (self.sizes[moving + (n - 1) // 2] + self.sizes[moving + n // 2]) / 2 if n else 0.0
        out = self.sizes[-1] / middle if middle else float("inf")
        if new is not None:
            del self.sizes[bisect_left(self.sizes, new)]
        for s in gone:
            insort(self.sizes, s)
        return out

    def remove(self, i: int) -> None:
        gone, new = self._without(i)
        for s in gone:
            del self.sizes[bisect_left(self.sizes, s)]
        a, b = self.before[i], self.after[i]
        self.steps.pop(i, None)
        self.steps.pop(a, None)
        if new is not None:
            self.steps[a] = new
            insort(self.sizes, new)
        if a >= 0:
            self.after[a] = b
        if b >= 0:
            self.before[b] = a

    def worst(self) -> int:
        """Where the greatest step begins, the first of equal ones."""
        most = self.sizes[-1]
        return min(k for k, s in self.steps.items() if s == most)


def removed(frames: list, centres: np.ndarray, ratio: float = RATIO, budget: float = BUDGET) -> tuple[list[int], bool]:
    """Places of the frames to remove, and whether the path is smooth without them.  While the greatest step is over ratio
    times the median, that end of it goes whose removal leaves the smoother path; a path that needs more than the budget keeps all."""
    path, out, left = Path(frames, centres), [], len(frames)
    while left > 2 and path.ratio() > ratio:
        if len(out) >= int(len(frames) * budget):
            return [], False
        a = path.worst()
        i = min((a, path.after[a]), key=path.ratio)
        path.remove(i)
        out.append(i)
        left -= 1
    return out, left < 2 or path.ratio() <= ratio


def trajectory_outliers(poses: DataFrame, keys: list[str], frame: str, xyz: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """(keys, frame, removed, smooth) of every pose with whole coordinates: whether it is removed, and whether its session's
    path is smooth then.  Sessions are handled apart, many at a time; each is sequential by definition and its frames (40 bytes
    each) are one group."""
    kinds = [f"`{c}` {poses.schema[c].dataType.simpleString()}" for c in (*keys, frame)]
    kept = poses.dropna(subset=[*keys, frame, *xyz]).select(*keys, frame, *xyz)

    def session(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([frame, *xyz]).reset_index(drop=True)
        gone, smooth = removed(rows[frame].tolist(), rows[list(xyz)].to_numpy(float))
        return rows[[*keys, frame]].assign(removed=rows.index.isin(gone), smooth=smooth)

    return kept.groupBy(*keys).applyInPandas(session, ", ".join([*kinds, "removed boolean", "smooth boolean"]))
