"""Levelling of scanned pages, on arrays: an image lives in a task only, never in a column."""

from __future__ import annotations

import numpy as np

# Fixed values.
LEAST_DARK, LEAST_ANGLE = 50, 0.5


def _threshold(grey: np.ndarray) -> int:
    """The grey value that parts dark from light with the greatest variance between the two."""
    n = np.bincount(grey.ravel(), minlength=256).astype(float)
    below, mass = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.nanargmax(between)) if np.isfinite(between).any() else -1


def _hull(points: np.ndarray) -> np.ndarray:
    """The convex hull of (x, y), which only the outermost dark pixels of each row can be on."""
    points = points[np.lexsort((points[:, 1], points[:, 0]))].astype(float)

    def half(some: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in some:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(points) + half(points[::-1]))


def skew(image: np.ndarray) -> float:
    """Degrees by which the least rectangle around the dark pixels is turned, above -45 up to 45; 0 with too few."""
    grey = np.rint(image[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8) if image.ndim == 3 else image
    dark = grey <= _threshold(grey)
    if dark.sum() < LEAST_DARK:
        return 0.0
    rows = np.flatnonzero(dark.any(axis=1))
    first, last = dark[rows].argmax(axis=1), dark.shape[1] - 1 - dark[rows][:, ::-1].argmax(axis=1)
    hull = _hull(np.unique(np.concatenate([np.column_stack([first, rows]), np.column_stack([last, rows])]), axis=0))
    if len(hull) < 3:
        return 0.0
    edges = np.roll(hull, -1, axis=0) - hull
    turns = np.arctan2(edges[:, 1], edges[:, 0])
    x = np.outer(np.cos(turns), hull[:, 0]) + np.outer(np.sin(turns), hull[:, 1])
    y = np.outer(np.cos(turns), hull[:, 1]) - np.outer(np.sin(turns), hull[:, 0])
    best = np.degrees(turns[np.argmin(np.ptp(x, axis=1) * np.ptp(y, axis=1))])
    return float(45.0 - (45.0 - best) % 90.0)


def deskew(image: np.ndarray) -> np.ndarray:
    """The image turned level, of equal size, its border repeated; as it is if it is level within half a degree."""
    angle = skew(image)
    if abs(angle) < LEAST_ANGLE:
        return image
    h, w = image.shape[:2]
    c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    out = np.empty_like(image)
    xs = np.arange(w) - w // 2
    for top in range(0, h, 256):  # in strips, which bounds the coordinates held
        ys = np.arange(top, min(top + 256, h))[:, None] - h // 2
        x = np.clip(c * xs - s * ys + w // 2, 0, w - 1)
        y = np.clip(s * xs + c * ys + h // 2, 0, h - 1)
        x0, y0 = x.astype(int), y.astype(int)
        x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
        fx, fy = x - x0, y - y0
        if image.ndim == 3:
            fx, fy = fx[..., None], fy[..., None]
        mixed = (image[y0, x0] * (1 - fx) + image[y0, x1] * fx) * (1 - fy) + (image[y1, x0] * (1 - fx) + image[y1, x1] * fx) * fy
        out[top : top + 256] = np.rint(mixed)
    return out
