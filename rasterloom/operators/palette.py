"""Palette quantising by median cut, with error diffusion; from the literature, checked by properties."""

from __future__ import annotations

import numpy as np

from rasterloom.sources.codecs import CodecError, Image


def within(image: Image, most: int) -> bool:
    """Whether an image has at most so many colours."""
    return len(np.unique(image.pixels.reshape(-1, image.pixels.shape[2]), axis=0)) <= most


def median_cut(colours: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """At most size colours: boxes are split at the median of their widest channel, the heaviest spread first."""
    boxes = [np.arange(len(colours))]
    while len(boxes) < size:
        spread = [(np.ptp(colours[b], 0).max() * counts[b].sum() if len(b) > 1 else -1, -n) for n, b in enumerate(boxes)]
        gain, at = max(spread)
        if gain <= 0:
            break
        box = boxes.pop(-at)
        channel = np.ptp(colours[box], 0).argmax()
        box = box[np.argsort(colours[box, channel], kind="stable")]
        half = np.searchsorted(np.cumsum(counts[box]), counts[box].sum() / 2) + 1
        half = min(max(half, 1), len(box) - 1)
        boxes += [box[:half], box[half:]]
    return np.stack([np.floor(np.average(colours[b], 0, counts[b]) + 0.5) for b in boxes]).astype(np.uint8)


def quantise(image: Image, size: int, dither: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(palette RGBA, indices height x width) of an 8-bit RGBA image; dither: 0 to 100 percent of the error.

    An image of at most size colours keeps every sample.
    """
    if image.depth != "u8" or image.color != "rgba" or not 2 <= size <= 256:
        raise CodecError("params", "a palette of 2 to 256 colours takes 8-bit RGBA")
    px = image.pixels
    colours, inverse, counts = np.unique(px.reshape(-1, 4), axis=0, return_inverse=True, return_counts=True)
    if len(colours) <= size:
        return colours, inverse.reshape(px.shape[:2])
    palette = median_cut(colours.astype(np.int64), counts, size)
    table = palette.astype(np.float64)
    if not dither:
        near = np.array([((table - c) ** 2).sum(1).argmin() for c in colours.astype(np.float64)])
        return palette, near[inverse].reshape(px.shape[:2])
    work = px.astype(np.float64)
    index = np.zeros(px.shape[:2], np.int64)
    share = dither / 100 / 16
    height, width = index.shape
    for y in range(height):
        for x in range(width):
            want = np.clip(work[y, x], 0, 255)
            k = ((table - want) ** 2).sum(1).argmin()
            index[y, x] = k
            error = (want - table[k]) * share
            for dx, dy, n in ((1, 0, 7), (-1, 1, 3), (0, 1, 5), (1, 1, 1)):
                if 0 <= x + dx < width and y + dy < height:
                    work[y + dy, x + dx] += error * n
    return palette, index
