"""Driver-side key arithmetic: code intervals that cover a box, depths for radii, hints for choosing a plan."""

from __future__ import annotations

import math

MAX_LEVEL = 21


def morton_int(x: int, y: int, z: int) -> int:
    return sum((x >> b & 1) << 3 * b | (y >> b & 1) << 3 * b + 1 | (z >> b & 1) << 3 * b + 2 for b in range(MAX_LEVEL))


def decode_int(code: int) -> tuple[int, int, int]:
    return tuple(sum((code >> 3 * b + a & 1) << b for b in range(MAX_LEVEL)) for a in range(3))


def box_intervals(low: tuple[int, int, int], high: tuple[int, int, int], level: int, most: int | None = None) -> list[tuple[int, int]]:
    """Maximal runs [a, b] of codes of the cells in the closed index box, in order.

    The cube of the level is halved again and again; a sub-cube inside the box is one run. With `most`, the runs with
    the smallest gaps are joined until no more are left (they then cover more than the box)."""
    found: list[list[int]] = []
    stack = [((0, 0, 0), 1 << level, 0)]
    while stack:
        at, size, code = stack.pop()
        if any(a > h or a + size - 1 < lo for a, lo, h in zip(at, low, high, strict=True)):
            continue
        if all(lo <= a and a + size - 1 <= h for a, lo, h in zip(at, low, high, strict=True)):
            if found and found[-1][1] == code - 1:
                found[-1][1] = code + size**3 - 1
            else:
                found.append([code, code + size**3 - 1])
            continue
        half = size // 2
        for k in range(7, -1, -1):
            stack.append((tuple(a + half * (k >> b & 1) for b, a in enumerate(at)), half, code + k * half**3))
    if most and len(found) > most:
        gaps = sorted(range(1, len(found)), key=lambda k: found[k][0] - found[k - 1][1], reverse=True)[: most - 1]
        cuts = [0, *sorted(gaps), len(found)]
        found = [[found[a][0], found[b - 1][1]] for a, b in zip(cuts, cuts[1:], strict=False)]
    return [tuple(f) for f in found]


def world_box_intervals(box: tuple[float, ...], level: int, most: int | None = None) -> list[tuple[int, int]]:
    """Runs of codes that cover the closed world box (min x, y, z, max x, y, z), cut to the domain."""
    size, last = 1 << (MAX_LEVEL - level), (1 << level) - 1
    low = tuple(max(0, math.floor(v / size)) for v in box[:3])
    high = tuple(min(last, math.floor(v / size)) for v in box[3:])
    return [] if any(a > b for a, b in zip(low, high, strict=True)) else box_intervals(low, high, level, most)


def next_in_box(code: int, low: tuple[int, int, int], high: tuple[int, int, int], level: int) -> int | None:
    """The first code at or after `code` whose cell is in the box."""
    return next((max(a, code) for a, b in box_intervals(low, high, level) if b >= code), None)


def depth_of_radius(radius: float) -> int:
    """The finest level whose cell diagonal reaches the radius."""
    return next((level for level in range(MAX_LEVEL, -1, -1) if (1 << (MAX_LEVEL - level)) * math.sqrt(3.0) >= radius), 0)


def level_for(n: int, extent: tuple[float, float, float], per_cell: int = 100, least: int = 10) -> int:
    """Level for a bulk load: eight children a level until cells hold per_cell, coarser for wide spreads, in 5..15."""
    if n == 0:
        return 10
    dx, dy, dz = extent
    if dx * dy * dz == 0:
        return 15
    cells = max(1, min(n // per_cell, n // least))
    level = math.ceil(math.log(cells) / math.log(8) - 1e-12)
    spread = (dx + dy + dz) / 3
    level = max(5, level - 2) if spread > 10_000 else max(6, level - 1) if spread > 1000 else level
    return max(5, min(15, level))


def recommend(insert_rate: float, range_rate: float, knn_rate: float) -> str:
    """Which physical layout suits a workload: 'tree' (adaptive cells) or 'curve' (one sorted level)."""
    queries = range_rate + knn_rate
    if queries and knn_rate / queries > 0.6:
        return "tree"
    if insert_rate > 2 * queries or range_rate > 2 * knn_rate:
        return "curve"
    return "tree"


def estimate_nodes(total: int, sample: int, cells_in_sample: int) -> int:
    """Cells of the whole from those of a sample, with a fifth on top."""
    return 0 if not sample else int(cells_in_sample * (total / sample) * 1.2)
