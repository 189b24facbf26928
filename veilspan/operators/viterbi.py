"""Constrained decoding of tag scores, and spans from tags."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np

from ..config import LABELS, N_TAGS, Calibration

FORBIDDEN = -1e30


def boundary(c: int) -> str:
    return "O" if c == 0 else "BIES"[(c - 1) % 4]


def label_of(c: int) -> int:
    return -1 if c == 0 else (c - 1) // 4


def allowed(before: int, after: int) -> bool:
    """Outside, E and S lead to O, B and S; B and I to I and E of their label."""
    if boundary(before) in "OES":
        return boundary(after) in "OBS"
    return boundary(after) in "IE" and label_of(before) == label_of(after)


def transition_bias(before: int, after: int, c: Calibration) -> float:
    a, b = boundary(before), boundary(after)
    if a == "O":
        return c.background_stay if b == "O" else c.background_to_start
    if a in "BI":
        return c.inside_to_continue if b == "I" else c.inside_to_end
    return c.end_to_background if b == "O" else c.end_to_start


@lru_cache(maxsize=16)
def transition_scores(calibration: Calibration = Calibration(), n: int = N_TAGS) -> np.ndarray:
    return np.array([[transition_bias(a, b, calibration) if allowed(a, b) else FORBIDDEN for b in range(n)] for a in range(n)], dtype=np.float32)


def viterbi(scores: np.ndarray, calibration: Calibration = Calibration()) -> np.ndarray:
    """The best path through (tokens, tags) that begins with O, B or S and ends with O, E or S; of equal ones the lowest tags."""
    scores = np.asarray(scores, dtype=np.float32)
    n, tags = scores.shape
    if not n:
        return np.zeros(0, dtype=np.int64)
    moves = transition_scores(calibration, tags)
    kinds = np.array([boundary(c) for c in range(tags)])
    best = np.where(np.isin(kinds, list("OBS")), np.float32(0), np.float32(FORBIDDEN)) + scores[0]
    back = np.zeros((n, tags), dtype=np.int64)
    for t in range(1, n):
        through = best[:, None] + moves
        back[t] = through.argmax(axis=0)
        best = through[back[t], np.arange(tags)] + scores[t]
    path = [int(np.argmax(best + np.where(np.isin(kinds, list("OES")), np.float32(0), np.float32(FORBIDDEN))))]
    for t in range(n - 1, 0, -1):
        path.append(int(back[t, path[-1]]))
    return np.array(path[::-1])


def tag_spans(tokens: Sequence[tuple[int, int, int]], tags: Sequence[int]) -> list[tuple[int, int, str]]:
    """Spans (start, end, label) of tokens (id, start, end). An I or E of another label takes over an open span, which is lost."""
    out: list[tuple[int, int, str]] = []
    opened: list | None = None

    def close():
        nonlocal opened
        if opened:
            out.append((opened[1], opened[2], LABELS[opened[0]]))
        opened = None

    for (_, start, end), c in zip(tokens, tags, strict=True):
        kind, label = boundary(int(c)), label_of(int(c))
        if kind in "OBS":
            close()
        if kind == "S":
            out.append((start, end, LABELS[label]))
        elif kind == "B" or (kind in "IE" and (opened is None or opened[0] != label)):
            opened = [label, start, end]
        elif kind in "IE":
            opened[2] = end
        if kind == "E":
            close()
    close()
    return out
