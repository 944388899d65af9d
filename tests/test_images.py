import math

import numpy as np
import pytest

from tallyweave.operators import images


def flood(prob):
    """Boxes by filling one region after another, pixel by pixel."""
    h, w = prob.shape
    seen, found = set(), []
    for start in range(h * w):
        if start in seen or prob[start // w, start % w] <= 0.3:
            continue
        todo, region = [start], {start}
        while todo:
            i = todo.pop()
            y, x = divmod(i, w)
            for v, u in ((y, x - 1), (y, x + 1), (y - 1, x), (y + 1, x)):
                if 0 <= v < h and 0 <= u < w and prob[v, u] > 0.3 and v * w + u not in region:
                    region.add(v * w + u)
                    todo.append(v * w + u)
        seen |= region
        ys, xs = [i // w for i in region], [i % w for i in region]
        wide, high = max(xs) - min(xs) + 1, max(ys) - min(ys) + 1
        score = sum(prob[i // w, i % w] for i in region) / len(region)
        if min(wide, high) >= 3 and score >= 0.5:
            px, py = math.floor(wide * 0.3 + 0.5), math.floor(high * 0.3 + 0.5)
            found.append((max(0, min(xs) - px), max(0, min(ys) - py), min(w - 1, max(xs) + px), min(h - 1, max(ys) + py), pytest.approx(score)))
    return found


@pytest.mark.parametrize("shape", [(8, 8), (13, 40), (1, 9)])
def test_regions_as_flood_fill(shape):
    rng = np.random.default_rng(shape[0])
    maps = rng.random((120, *shape))
    # Smooth some, so that regions wind; draw a spiral, whose labels have far to go.
    maps[::2] = (maps[::2] + np.roll(maps[::2], 1, 2) + np.roll(maps[::2], 1, 1)) / 2.4
    maps[0] = 0
    if shape == (13, 40):
        for k in range(0, 6, 2):
            maps[0, k, k : 40 - k] = maps[0, k : 13 - k, 39 - k] = maps[0, 12 - k, k : 40 - k] = maps[0, k + 2 : 13 - k, k] = 0.9
            maps[0, k + 2, k : k + 3] = 0.9
    found = images.regions(maps)
    assert [flood(m) for m in maps] == found
    assert shape[0] == 1 or sum(map(len, found)) > 30


def lines(degrees, h=160, w=200):
    ink = np.zeros((h, w), bool)
    x = np.arange(10, w - 10)
    for y in range(25, h - 20, 12):
        rows = np.round(y - (x - w / 2) * math.tan(math.radians(degrees))).astype(int)
        for d in (0, 1):
            ok = (rows + d >= 0) & (rows + d < h)
            ink[rows[ok] + d, x[ok]] = True
    return ink


@pytest.mark.parametrize("degrees", [0, 0.1, 1.5, -2, 3.7, -6, 7.9])
def test_tilt_of_lines(degrees):
    found = images.tilt(lines(degrees))
    assert found == (0 if abs(degrees) < 0.3 else pytest.approx(degrees, abs=0.35))
    assert abs(found) <= 8


def test_no_tilt_without_ink_or_gain():
    rng = np.random.default_rng(1)
    assert images.tilt(np.zeros((50, 50), bool)) == 0
    assert images.tilt(rng.random((80, 80)) < 0.5) == 0


def brute_box(gray):
    h, w = gray.shape
    row, col = [0.0] * h, [0.0] * w
    for y in range(1, h - 1):
        for x in range(1, w - 1):
            e = abs(gray[y, x + 1] - gray[y, x - 1]) + abs(gray[y + 1, x] - gray[y - 1, x])
            row[y] += e
            col[x] += e
    best = None
    # Of all boxes, the least whose outside holds only weak lines at the edges.
    ys = [y for y in range(h) if row[y] >= 0.06 * max(row)]
    xs = [x for x in range(w) if col[x] >= 0.06 * max(col)]
    for y0 in range(h):
        for y1 in range(y0, h):
            if all(y0 <= y <= y1 for y in ys) and (best is None or y1 - y0 < best[1] - best[0]):
                best = (y0, y1)
    across = None
    for x0 in range(w):
        for x1 in range(x0, w):
            if all(x0 <= x <= x1 for x in xs) and (across is None or x1 - x0 < across[1] - across[0]):
                across = (x0, x1)
    return across[0], best[0], across[1] - across[0] + 1, best[1] - best[0] + 1


def brute_borders(gray):
    h, w = gray.shape
    dark = lambda line: sum(v < 80 for v in line) / len(line) >= 0.3
    found = []
    for at, n in ((lambda i: gray[:, i], w), (lambda i: gray[i], h), (lambda i: gray[:, w - 1 - i], w), (lambda i: gray[h - 1 - i], h)):
        k = 0
        while k < int(n * 0.08) and dark(at(k)):
            k += 1
        found.append(k)
    return found


def test_borders_boxes_and_crops():
    rng = np.random.default_rng(4)
    maps = []
    for k in range(60):
        m = np.full((26, 30), 250.0)
        y, x = rng.integers(0, 12), rng.integers(0, 12)
        m[y : y + rng.integers(3, 20), x : x + rng.integers(3, 22)] = 0
        m += rng.random(m.shape) * (k % 3)
        m[: k % 4] = 10
        m[:, 29 - k % 2 :] = 10 if k % 5 == 0 else m[:, 29 - k % 2 :]
        maps.append(m)
    maps.append(np.zeros((26, 30)))
    maps = np.array(maps)
    assert images.content_boxes(maps).tolist() == [list(brute_box(m)) for m in maps]
    assert images.dark_borders(maps).tolist() == [brute_borders(m) for m in maps]
    for m, (x, y, w, h), crop in zip(maps, images.content_boxes(maps).tolist(), images.crops(maps).tolist()):
        left, top, right, bottom = brute_borders(m)
        x1, y1 = max(x, left), max(y, top)
        w1, h1 = max(1, min(x + w, 30 - right) - x1), max(1, min(y + h, 26 - bottom) - y1)
        if w1 * h1 > 0.45 * 780 and w1 > 12 and h1 > 26 * 0.4:
            assert crop == pytest.approx([max(0, x1 - w1 * 0.02), max(0, y1 - h1 * 0.02), min(30, w1 * 1.04), min(26, h1 * 1.04)])
        else:
            assert crop == [left, top, 30 - left - right, 26 - top - bottom]


def test_maps_of_many_shapes(spark):
    """In a table: shapes of their own, nulls, widths that don't fit, repeated keys."""
    m = lambda h, w: [0.9] * (h * w)
    rows = [(1, m(4, 4), 4), (2, m(3, 5), 5), (3, m(3, 5), 4), (4, None, 3), (5, [], 3), (6, m(2, 2), None), (7, [0.9, None], 2), (None, m(3, 3), 3), (1, m(4, 4), 4)]
    table = spark.createDataFrame(rows, "k long, v array<double>, w int")
    found = [(r.k, r.box, r.x1, r.y1, r.score) for r in images.text_regions(table, "k", "v", "w").collect()]
    assert sorted(found, key=str) == sorted([(k, 0, x, y, pytest.approx(0.9)) for k, x, y in ((1, 3, 3), (1, 3, 3), (2, 4, 2), (None, 2, 2))], key=str)
    ink = spark.createDataFrame([(1, lines(2.0).ravel().astype(float).tolist(), 200), (2, [0.0] * 9, 3)], "k long, v array<double>, w int")
    assert {r.k: r.degrees for r in images.tilts(ink, "k", "v", "w").collect()} == {1: pytest.approx(2, abs=0.35), 2: 0}
    assert images.cropped(table.where("false"), "k", "v", "w").count() == 0
