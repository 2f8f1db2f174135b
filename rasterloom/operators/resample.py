"""Resampling of packed images with separable kernels, in linear light with premultiplied alpha."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from rasterloom.sources.codecs import CHANNELS, CodecError, Image


def _cubic(b: float, c: float) -> Callable[[np.ndarray], np.ndarray]:
    """The two-parameter family of cubic kernels."""

    def kernel(x: np.ndarray) -> np.ndarray:
        x = np.abs(x)
        near = ((12 - 9 * b - 6 * c) * x**3 + (-18 + 12 * b + 6 * c) * x**2 + (6 - 2 * b)) / 6
        far = ((-b - 6 * c) * x**3 + (6 * b + 30 * c) * x**2 + (-12 * b - 48 * c) * x + (8 * b + 24 * c)) / 6
        return np.where(x < 1, near, np.where(x < 2, far, 0.0))

    return kernel


#: Kernels and how far they reach, at a scale of one.
KERNELS: dict[str, tuple[Callable[[np.ndarray], np.ndarray], float]] = {
    "box": (lambda x: ((x >= -0.5) & (x < 0.5)).astype(float), 0.5),
    "bilinear": (lambda x: np.maximum(0, 1 - np.abs(x)), 1.0),
    "catmull-rom": (_cubic(0.0, 0.5), 2.0),
    "mitchell": (_cubic(1 / 3, 1 / 3), 2.0),
    "lanczos3": (lambda x: np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0), 3.0),
}


def weights(start: float, length: float, size: int, out: int, name: str) -> np.ndarray:
    """out x size weights that take samples start .. start + length to out samples."""
    kernel, reach = KERNELS[name]
    scale = length / out
    wide = max(scale, 1.0)
    centre = start + (np.arange(out) + 0.5) * scale
    at = (np.arange(size) + 0.5)[None, :] - centre[:, None]
    w = np.where(np.abs(at) <= reach * wide, kernel(at / wide), 0.0)
    total = w.sum(1, keepdims=True)
    nearest = np.zeros_like(w)
    nearest[np.arange(out), np.clip(centre.astype(int), 0, size - 1)] = 1
    return np.where(np.abs(total) > 1e-12, w / np.where(total == 0, 1, total), nearest)


def to_linear(v: np.ndarray) -> np.ndarray:
    return np.where(v <= 0.04045, v / 12.92, ((np.maximum(v, 0.04045) + 0.055) / 1.055) ** 2.4)


def to_srgb(v: np.ndarray) -> np.ndarray:
    v = np.clip(np.nan_to_num(v, nan=0.0), 0, 1)
    return np.where(v <= 0.0031308, 12.92 * v, 1.055 * np.maximum(v, 0.0031308) ** (1 / 2.4) - 0.055)


def resample(image: Image, width: int, height: int, name: str = "lanczos3", crop: tuple[float, float, float, float] | None = None) -> Image:
    """image, or its crop (left, top, width, height), as width x height.

    nearest copies samples as they are. Whole samples are mixed in linear light and come back in their
    own depth; float samples are linear already and never go below zero.
    """
    if width < 1 or height < 1:
        raise CodecError("params", "a side is zero")
    left, top, w, h = crop or (0.0, 0.0, float(image.width), float(image.height))
    px = image.pixels
    if name == "nearest":
        x = np.clip(np.floor(left + (np.arange(width) + 0.5) * w / width).astype(int), 0, image.width - 1)
        y = np.clip(np.floor(top + (np.arange(height) + 0.5) * h / height).astype(int), 0, image.height - 1)
        return Image(width, height, image.color, px[np.ix_(y, x)])
    if name not in KERNELS:
        raise CodecError("params", f"no filter {name}")
    most = {"u8": 255.0, "u16": 65535.0, "f32": 1.0}[image.depth]
    has_alpha = image.color in ("gray_alpha", "rgba")
    v = px.astype(np.float64) / most
    colour = v[:, :, : CHANNELS[image.color] - has_alpha]
    if image.depth != "f32":
        colour = to_linear(colour)
    if has_alpha:
        colour = np.concatenate([colour * v[:, :, -1:], v[:, :, -1:]], 2)
    rows = np.einsum("oh,hwc->owc", weights(top, h, image.height, height, name), colour)
    out = np.einsum("ow,hwc->hoc", weights(left, w, image.width, width, name), rows)
    if has_alpha:
        alpha = np.clip(out[:, :, -1:], 0, 1)
        colour = np.where(alpha > 1e-9, out[:, :, :-1] / np.maximum(alpha, 1e-9), 0)
    else:
        alpha, colour = out[:, :, :0], out
    if image.depth == "f32":
        return Image(width, height, image.color, np.maximum(np.concatenate([colour, alpha], 2), 0).astype(np.float32))
    done = np.concatenate([to_srgb(colour), alpha], 2)
    return Image(width, height, image.color, np.floor(done * most + 0.5).astype(image.samples.dtype))


def padded(image: Image, width: int, height: int, x: int, y: int, background: tuple[int, int, int, int]) -> Image:
    """image at x, y of a canvas; its layout grows where the background needs colour or alpha."""
    if x < 0 or y < 0 or x + image.width > width or y + image.height > height:
        raise CodecError("params", "the image doesn't fit the canvas")
    grey = image.color.startswith("gray") and len(set(background[:3])) == 1
    alpha = image.color in ("gray_alpha", "rgba") or background[3] < 255
    color = ("gray" if grey else "rgb") + ("_alpha" if grey and alpha else "a" if alpha else "")
    full = {"u8": 255, "u16": 65535, "f32": 1.0}[image.depth]
    back = np.array(background, np.float64) / 255
    if image.depth == "f32":
        back[:3] = to_linear(back[:3])
    back = np.floor(back * full + 0.5) if image.depth != "f32" else back
    px = image.pixels
    own_alpha = px[:, :, -1:] if image.color in ("gray_alpha", "rgba") else np.full((*px.shape[:2], 1), full, px.dtype)
    colour = px[:, :, : 1 if image.color.startswith("gray") else 3]
    colour = colour if grey else np.broadcast_to(colour, (*px.shape[:2], 3))
    whole = np.concatenate([colour, own_alpha], 2) if alpha else colour
    value = np.concatenate([back[:1] if grey else back[:3], back[3:] if alpha else back[:0]])
    out = np.empty((height, width, CHANNELS[color]), image.samples.dtype)
    out[:] = value.astype(image.samples.dtype)
    out[y : y + image.height, x : x + image.width] = whole
    return Image(width, height, color, out)


def upright(image: Image, orientation: int) -> Image:
    """image after undoing its EXIF orientation."""
    from rasterloom.functions.orientation import PARTS

    swap, flip_x, flip_y = PARTS.get(orientation, (0, 0, 0))
    px = image.pixels.transpose(1, 0, 2) if swap else image.pixels
    px = px[:, ::-1] if flip_x else px
    px = px[::-1] if flip_y else px
    return Image(px.shape[1], px.shape[0], image.color, np.ascontiguousarray(px))


def through_matrix(image: Image, matrix: np.ndarray) -> Image:
    """Linear RGB through a 3 x 3 matrix, clipped below zero; alpha stays."""
    if image.depth != "f32" or not image.color.startswith("rgb"):
        raise CodecError("unsupported", "a matrix takes linear RGB")
    if abs(np.linalg.det(matrix)) < 1e-6:
        raise CodecError("params", "the matrix is singular")
    px = image.pixels
    mixed = np.maximum(np.einsum("ij,hwj->hwi", np.asarray(matrix, np.float64), px[:, :, :3]), 0)
    return Image(image.width, image.height, image.color, np.concatenate([mixed.astype(np.float32), px[:, :, 3:]], 2))
