"""Drawn photographs of the reference card, for tests."""

from __future__ import annotations

import numpy as np

from capturelake.functions import card


def linear(colour: str) -> np.ndarray:
    c = np.array([int(colour[i : i + 2], 16) for i in (1, 3, 5)]) / 255
    return np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)


def encoded(light: np.ndarray) -> np.ndarray:
    c = np.clip(light, 0, 1)
    return np.rint(np.where(c <= 0.0031308, c * 12.92, 1.055 * c ** (1 / 2.4) - 0.055) * 255).astype(np.uint8)


def homography(k: float = 5.0, off=(40.0, 35.0), tilt=(0.0, 0.0), skew=0.0) -> list[float]:
    return [k, skew, off[0], skew * 0.5, k, off[1], tilt[0], tilt[1], 1.0]


def photograph(sample: str, gains=(1.0, 1.0, 1.0), h=None, size=(560, 360), hide=(), key=True, blur=0, gradient=0.0, patches=None) -> np.ndarray:
    """8-bit frame (height, width, 3) of a card with its sample window filled; ``hide`` leaves out markers, ``blur`` averages over
    so many pixels each way, ``gradient`` brightens to the right; ``patches`` replace patch colours."""
    h = h or homography()
    width, height = size
    y, x = np.mgrid[0:height, 0:width].astype(float)
    m = np.linalg.inv(np.array(h).reshape(3, 3))
    w = m[2, 0] * x + m[2, 1] * y + m[2, 2]
    mx, my = (m[0, 0] * x + m[0, 1] * y + m[0, 2]) / w, (m[1, 0] * x + m[1, 1] * y + m[1, 2]) / w
    light = np.full((height, width, 3), 0.35)
    light[(mx >= 0) & (mx <= card.WIDTH) & (my >= 0) & (my <= card.HEIGHT)] = linear("#ececec")
    for p in card.patch_rows():
        light[(mx >= p[5]) & (mx <= p[5] + p[7]) & (my >= p[6]) & (my <= p[6] + p[8])] = linear((patches or {}).get(p[0], p[11]))
    x0, y0, ww, wh = card.WINDOW
    light[(mx >= x0) & (mx <= x0 + ww) & (my >= y0) & (my <= y0 + wh)] = linear(sample)
    for i, (cx, cy) in enumerate(card.MARKERS):
        if i not in hide:
            light[(np.abs(mx - cx) <= 4) & (np.abs(my - cy) <= 4)] = linear("#0e0e0e")
        if i == 0 and key:
            light[(np.abs(mx - cx) <= 4 / 3) & (np.abs(my - cy) <= 4 / 3)] = linear("#ececec")
    light = light * np.array(gains) * (1 + gradient * (mx / card.WIDTH - 0.5))[:, :, None]
    for axis in (0, 1):
        if blur:
            light = np.mean([np.roll(light, d, axis) for d in range(-blur, blur + 1)], axis=0)
    return encoded(light)
