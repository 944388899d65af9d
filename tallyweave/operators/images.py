"""What is found in small maps of pixels: connected regions, the tilt of lines, dark borders, the box of the content.

A map is a row with its values in an array, row by row, and its width. Batches of maps come to a task as Arrow arrays, and
maps of one shape are worked on together as one array of maps. A null or empty map, or one whose width does not divide its values,
has no regions, no tilt, no border and no box.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Least probability of a text pixel (exclusive) and of a region's mean, growth of a box by its sides, least side, most boxes.
BIN, BOX, EXPAND, LEAST_SIDE, MOST_BOXES = 0.3, 0.5, 0.3, 3, 1000
# Greatest tilt in degrees, coarse and fine step, least gain over no tilt, least tilt, least number of ink pixels.
MAX_TILT, COARSE, FINE, LEAST_GAIN, LEAST_TILT, LEAST_INK = 8.0, 0.5, 0.1, 1.05, 0.3, 64
# What is dark, the part of a line that is, and the part of a frame that a border may take at each edge.
DARK, DARK_PART, BORDER_PART = 80, 0.3, 0.08
# Energy of a line by that of the strongest, least area and sides of a crop by the frame's, padding by the box's.
ENERGY_PART, LEAST_AREA, LEAST_SIDES, PAD = 0.06, 0.45, 0.4, 0.02


def _half_up(x: np.ndarray) -> np.ndarray:
    return np.floor(x + 0.5).astype(np.int64)


def region_labels(on: np.ndarray) -> np.ndarray:
    """For each pixel of maps (n, h, w) the least flat index of its region of 4-neighbours, -1 off. Union-find on arrays: a pixel is
    hooked to the least root beside it, then every pointer is doubled, until nothing moves."""
    n, h, w = on.shape
    flat = on.ravel()
    root = np.where(flat, np.arange(flat.size), -1)
    index = np.arange(flat.size).reshape(n, h, w)
    right = on[:, :, :-1] & on[:, :, 1:]
    down = on[:, :-1] & on[:, 1:]
    a = np.concatenate([index[:, :, :-1][right], index[:, :-1][down]])
    b = np.concatenate([index[:, :, 1:][right], index[:, 1:][down]])
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        low, high = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        np.minimum.at(root, high, low)
        pixels = np.flatnonzero(flat)
        while True:
            further = root[root[pixels]]
            if (further == root[pixels]).all():
                break
            root[pixels] = further
        a, b = a[apart], b[apart]
    return root.reshape(n, h, w)


def regions(maps: np.ndarray) -> list[list[tuple]]:
    """Boxes (x0, y0, x1, y1, score) of each map (n, h, w), in the order of their first pixel: regions of probable pixels with their mean
    probability, without small and weak ones, grown on every side."""
    n, h, w = maps.shape
    root = region_labels(maps > BIN).ravel()
    pixels = np.flatnonzero(root >= 0)
    found: list[list[tuple]] = [[] for _ in range(n)]
    if not len(pixels):
        return found
    names, which = np.unique(root[pixels], return_inverse=True)
    x, y = pixels % w, pixels // w % h
    low_x, low_y = np.full(len(names), w), np.full(len(names), h)
    high_x, high_y = np.full(len(names), -1), np.full(len(names), -1)
    np.minimum.at(low_x, which, x), np.minimum.at(low_y, which, y)
    np.maximum.at(high_x, which, x), np.maximum.at(high_y, which, y)
    # Summed by pixel order, so that a region's mean does not depend on how it was found.
    score = np.bincount(which, maps.ravel()[pixels]) / np.bincount(which)
    wide, high = high_x - low_x + 1, high_y - low_y + 1
    keep = (np.minimum(wide, high) >= LEAST_SIDE) & (score >= BOX)
    pad_x, pad_y = _half_up(wide * EXPAND), _half_up(high * EXPAND)
    boxes = zip(np.maximum(0, low_x - pad_x), np.maximum(0, low_y - pad_y), np.minimum(w - 1, high_x + pad_x), np.minimum(h - 1, high_y + pad_y), score)
    for name, good, box in zip(names // (w * h), keep, boxes):
        if good and len(found[name]) < MOST_BOXES:
            found[name].append((*(int(v) for v in box[:4]), float(box[4])))
    return found


def _profile_energy(x: np.ndarray, y: np.ndarray, h: int, degrees: float) -> int:
    row = _half_up(y + x * np.tan(np.radians(degrees)))
    return int((np.bincount(row[(row >= 0) & (row <= h + 1)], minlength=1).astype(np.int64) ** 2).sum())


def tilt(ink: np.ndarray) -> float:
    """Degrees to turn an ink mask (h, w) by so that its lines are level, or 0. Ink is projected onto rows along lines of each angle; level
    lines gather in few rows, whose squared sums are greatest. Coarse steps first, then fine ones around the best."""
    h, w = ink.shape
    y, x = np.nonzero(ink)
    if len(x) < max(LEAST_INK, w):
        return 0.0
    x = x - w / 2
    level = best = _profile_energy(x, y, h, 0.0)
    angle = 0.0

    def search(low: float, high: float, step: float) -> None:
        nonlocal best, angle
        at = low
        while at <= high + 1e-9:
            energy = _profile_energy(x, y, h, at)
            if energy > best:
                best, angle = energy, at
            at += step

    search(-MAX_TILT, MAX_TILT, COARSE)
    search(max(-MAX_TILT, angle - COARSE), min(MAX_TILT, angle + COARSE), FINE)
    return angle if abs(angle) >= LEAST_TILT and best >= level * LEAST_GAIN else 0.0


def dark_borders(gray: np.ndarray) -> np.ndarray:
    """(left, top, right, bottom) lines of each map (n, h, w) that are dark borders of a scan: from each edge inwards until the first line
    that is not dark enough."""
    n, h, w = gray.shape
    dark = gray < DARK
    rows, columns = dark.mean(axis=2) >= DARK_PART, dark.mean(axis=1) >= DARK_PART

    def inset(lines: np.ndarray, most: int) -> np.ndarray:
        return np.cumprod(lines[:, :most], axis=1, dtype=np.int64).sum(axis=1)

    tall, wide = int(h * BORDER_PART), int(w * BORDER_PART)
    return np.stack([inset(columns, wide), inset(rows, tall), inset(columns[:, ::-1], wide), inset(rows[:, ::-1], tall)], axis=1)


def content_boxes(gray: np.ndarray) -> np.ndarray:
    """(x, y, w, h) of each map (n, h, w) without its blank margins: lines at the edges whose gradients are weak beside the strongest."""
    n, h, w = gray.shape
    energy = np.zeros((n, h, w))
    if h > 2 and w > 2:
        energy[:, 1:-1, 1:-1] = np.abs(gray[:, 1:-1, 2:] - gray[:, 1:-1, :-2]) + np.abs(gray[:, 2:, 1:-1] - gray[:, :-2, 1:-1])

    def kept(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        strong = lines >= lines.max(axis=1, keepdims=True) * ENERGY_PART
        return strong.argmax(axis=1), lines.shape[1] - 1 - strong[:, ::-1].argmax(axis=1)

    top, bottom = kept(energy.sum(axis=2))
    left, right = kept(energy.sum(axis=1))
    return np.stack([left, top, right - left + 1, bottom - top + 1], axis=1)


def crops(gray: np.ndarray) -> np.ndarray:
    """(x, y, w, h) of what each map (n, h, w) is cut to: its content within its borders, padded; what lies within the borders where the content
    would leave too little of the frame."""
    n, h, w = gray.shape
    left, top, right, bottom = dark_borders(gray).T.astype(float)
    x, y, wide, high = content_boxes(gray).T.astype(float)
    x1, y1 = np.maximum(x, left), np.maximum(y, top)
    wide, high = np.maximum(1, np.minimum(x + wide, w - right) - x1), np.maximum(1, np.minimum(y + high, h - bottom) - y1)
    good = (wide * high / (w * h) > LEAST_AREA) & (wide > w * LEAST_SIDES) & (high > h * LEAST_SIDES)
    padded = np.stack([np.maximum(0, x1 - wide * PAD), np.maximum(0, y1 - high * PAD), np.minimum(w, wide * (1 + 2 * PAD)), np.minimum(h, high * (1 + 2 * PAD))], axis=1)
    inner = np.stack([left, top, np.maximum(1, w - left - right), np.maximum(1, h - top - bottom)], axis=1)
    return np.where(good[:, None], padded, inner)


#: Values of maps that are worked on at once.
MOST_VALUES = 1 << 20


def _parts(lists: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of parts of at most MOST_VALUES values or of one row."""
    share = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) // MOST_VALUES
    at = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), len(lists)]
    return ((a, b - a) for a, b in zip(at, at[1:]) if b > a)


def on_maps(images: DataFrame, key: str, values: str, width: str, use: Callable[[np.ndarray], list], schema: str) -> DataFrame:
    """Apply use, a function of maps (n, h, w), to all maps of each shape of a part of a batch, and hand on (key, its row) of each map;
    several rows if it gives a list of them. Parts are bounded by their values, which stay in arrays, so that memory is too."""
    rows = images.select(key, values, width)
    arrow = _arrow(f"{rows.schema[key].name} {rows.schema[key].dataType.simpleString()}, {schema}")

    def on_part(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, lists = batch.column(0).to_pylist(), batch.column(1)
        ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        flat = lists.flatten()
        gaps = flat.is_null().to_numpy(zero_copy_only=False)
        data = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
        spans = [(int(a), int(b)) for a, b in zip([0, *ends[:-1]], ends)]
        shapes: dict[tuple[int, int], list[int]] = {}
        for i, ((a, b), w) in enumerate(zip(spans, batch.column(2).to_pylist())):
            if b > a and w and w > 0 and (b - a) % w == 0 and not gaps[a:b].any():
                shapes.setdefault(((b - a) // w, w), []).append(i)
        found = []
        for (h, w), which in shapes.items():
            maps = np.stack([data[slice(*spans[i])] for i in which]).reshape(len(which), h, w)
            for i, r in zip(which, use(maps)):
                found += [(keys[i], *x) for x in (r if isinstance(r, list) else [tuple(r)])]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], f.type) for c, f in enumerate(arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in _parts(batch.column(1)):
                yield on_part(batch.slice(at, n))

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, {schema}")


_KINDS = {"int": pa.int32(), "bigint": pa.int64(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(n.strip("`"), _KINDS[t]) for n, t in (f.split() for f in schema.split(", "))])


def text_regions(images: DataFrame, key: str, values: str, width: str) -> DataFrame:
    """(key, box, x0, y0, x1, y1, score): the numbered text boxes of probability maps."""
    return on_maps(images, key, values, width, lambda m: [[(k, *b) for k, b in enumerate(boxes)] for boxes in regions(m)], "box int, x0 int, y0 int, x1 int, y1 int, score double")


def tilts(images: DataFrame, key: str, values: str, width: str) -> DataFrame:
    """(key, degrees): the tilt of each mask's ink, which is what is not 0. A mask goes to Python as a bit a pixel."""
    masks = images.select(key, F.transform(values, lambda x: x != 0).alias(values), width)
    return on_maps(masks, key, values, width, lambda m: [(tilt(x != 0),) for x in m], "degrees double")


def cropped(images: DataFrame, key: str, values: str, width: str) -> DataFrame:
    """(key, borders, content box and crop) of gray maps."""

    def use(m: np.ndarray) -> list:
        return [(*map(int, b), *map(int, c), *map(float, k)) for b, c, k in zip(dark_borders(m), content_boxes(m), crops(m))]

    return on_maps(images, key, values, width, use, ", ".join(f"{c} int" for c in ("left", "top", "right", "bottom", "x", "y", "w", "h")) + ", " + ", ".join(f"crop_{c} double" for c in "xywh"))
