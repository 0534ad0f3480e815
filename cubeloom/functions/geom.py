"""Geometry as portable SQL expressions over column names; operators use them through F.expr().

Points are prefixes: point "a" has the columns a_x, a_y, a_z... where a function takes names it says so. All distances
are doubles; all boxes are closed.
"""

from __future__ import annotations


def rounded(v: str, places: int = 6) -> str:
    """v rounded half away from zero as DuckDB does it. Spark's round() goes through decimals, which takes longer than
    finding a pair; large values, NaN and null are left to it."""
    scale = f"1e{places}D"
    up = f"floor(abs({v}) * {scale} + 0.5D)"
    return f"CASE WHEN abs({v}) < 1e9D THEN CASE WHEN {v} < 0 THEN -{up} ELSE {up} END / {scale} ELSE round({v}, {places}) END"


def dist2(a: tuple[str, str, str], b: tuple[str, str, str]) -> str:
    return " + ".join(f"(({p}) - ({q})) * (({p}) - ({q}))" for p, q in zip(a, b, strict=True))


def dist(a, b) -> str:
    return f"sqrt({dist2(a, b)})"


def dot(a, b) -> str:
    return " + ".join(f"({p}) * ({q})" for p, q in zip(a, b, strict=True))


def in_box(p, low, high) -> str:
    return "(" + " AND ".join(f"({c}) >= ({a}) AND ({c}) <= ({b})" for c, a, b in zip(p, low, high, strict=True)) + ")"


def boxes_overlap(low1, high1, low2, high2) -> str:
    return "(" + " AND ".join(f"({a}) <= ({d}) AND ({b}) >= ({c})" for a, b, c, d in zip(low1, high1, low2, high2, strict=True)) + ")"


def box_inside(low1, high1, low2, high2) -> str:
    return "(" + " AND ".join(f"({a}) >= ({c}) AND ({b}) <= ({d})" for a, b, c, d in zip(low1, high1, low2, high2, strict=True)) + ")"


def clamp(v: str, low: str, high: str) -> str:
    return f"greatest(({low}), least(({high}), ({v})))"


def box_distance(p, low, high) -> str:
    """From a point to a box; 0 inside."""
    return dist(p, tuple(clamp(c, a, b) for c, a, b in zip(p, low, high, strict=True)))


def plane_value(plane, p) -> str:
    a, b, c, d = plane
    return f"(({a}) * ({p[0]}) + ({b}) * ({p[1]}) + ({c}) * ({p[2]}) + ({d}))"


def plane_extremes(plane, low, high) -> tuple[str, str]:
    """Least and greatest signed distance of a box's corners."""
    terms = [(f"({n}) * ({a})", f"({n}) * ({b})") for n, a, b in zip(plane[:3], low, high, strict=True)]
    return tuple("(" + " + ".join(f"{which}({a}, {b})" for a, b in terms) + f" + ({plane[3]}))" for which in ("least", "greatest"))


def plane_class(plane, low, high, tolerance: float = 1e-6) -> tuple[str, str]:
    """Class and distance of a box: ON_PLANE (mean), INTERSECTING (the smaller magnitude), or the side (nearest corner)."""
    near, far = plane_extremes(plane, low, high)
    kind = f"CASE WHEN abs({near}) <= {tolerance!r} AND abs({far}) <= {tolerance!r} THEN 'ON_PLANE' WHEN {near} * {far} <= 0 THEN 'INTERSECTING' WHEN {near} > 0 THEN 'POSITIVE_SIDE' ELSE 'NEGATIVE_SIDE' END"
    distance = f"CASE WHEN abs({near}) <= {tolerance!r} AND abs({far}) <= {tolerance!r} THEN ({near} + {far}) / 2 WHEN {near} * {far} <= 0 THEN CASE WHEN abs({near}) < abs({far}) THEN {near} ELSE {far} END WHEN {near} > 0 THEN {near} ELSE {far} END"
    return kind, distance


def frustum_point(planes, p) -> str:
    return "(" + " AND ".join(f"{plane_value(q, p)} <= 0" for q in planes) + ")"


def frustum_box_meets(planes, low, high) -> str:
    """No plane has all corners at a distance of 0 or more."""
    return "(" + " AND ".join(f"{plane_extremes(q, low, high)[0]} < 0" for q in planes) + ")"


def frustum_box_inside(planes, low, high) -> str:
    return "(" + " AND ".join(f"{plane_extremes(q, low, high)[1]} <= 0" for q in planes) + ")"


def ray_box(o, d, low, high, most: str) -> str:
    """Entry distance in [0, most], null for a miss. d is a unit vector; |d| < 1e-6 on an axis counts as parallel."""
    near, far, out = [], [], []
    for p, v, a, b in zip(o, d, low, high, strict=True):
        flat = f"abs({v}) < 1e-6"
        safe = f"(CASE WHEN {flat} THEN 1.0 ELSE ({v}) END)"
        near.append(f"CASE WHEN {flat} THEN -1e300 ELSE least((({a}) - ({p})) / {safe}, (({b}) - ({p})) / {safe}) END")
        far.append(f"CASE WHEN {flat} THEN 1e300 ELSE greatest((({a}) - ({p})) / {safe}, (({b}) - ({p})) / {safe}) END")
        out.append(f"({flat} AND (({p}) < ({a}) OR ({p}) > ({b})))")
    t0, t1 = f"greatest(0.0, {', '.join(near)})", f"least(({most}), {', '.join(far)})"
    return f"CASE WHEN {' OR '.join(out)} THEN NULL WHEN {t0} > {t1} THEN NULL ELSE {t0} END"


def ray_sphere(o, d, c, r: str, most: str) -> str:
    """First hit in [0, most]: 0 from inside, null for a miss or a centre behind."""
    to = tuple(f"(({q}) - ({p}))" for p, q in zip(o, c, strict=True))
    t, m2 = f"({dot(to, d)})", f"({dot(to, to)})"
    h2 = f"(({r}) * ({r}) - ({m2} - {t} * {t}))"
    hit = f"({t} - sqrt(greatest({h2}, 0.0)))"
    return f"CASE WHEN {m2} <= ({r}) * ({r}) THEN 0.0 WHEN {t} < 0 OR {h2} < 0 THEN NULL WHEN {hit} >= 0 AND {hit} <= ({most}) THEN {hit} ELSE NULL END"


def cross(a, b) -> tuple[str, str, str]:
    return tuple(f"(({a[i]}) * ({b[j]}) - ({a[j]}) * ({b[i]}))" for i, j in ((1, 2), (2, 0), (0, 1)))


def minus(a, b) -> tuple[str, ...]:
    return tuple(f"(({p}) - ({q}))" for p, q in zip(a, b, strict=True))


def det3(a, b, c) -> str:
    return f"({dot(a, cross(b, c))})"


def ray_triangle(o, d, v0, v1, v2) -> str:
    """Distance to a triangle by Moeller and Trumbore; null for a miss."""
    e1, e2 = minus(v1, v0), minus(v2, v0)
    p = cross(d, e2)
    det = f"({dot(e1, p)})"
    safe = f"(CASE WHEN abs({det}) < 1e-12 THEN 1.0 ELSE {det} END)"
    s = minus(o, v0)
    q = cross(s, e1)
    u, v, t = f"(({dot(s, p)}) / {safe})", f"(({dot(d, q)}) / {safe})", f"(({dot(e2, q)}) / {safe})"
    return f"CASE WHEN abs({det}) < 1e-12 OR {u} < 0 OR {v} < 0 OR {u} + {v} > 1 OR {t} < 0 THEN NULL ELSE {t} END"


def in_tetrahedron(p, a, b, c, d, eps: float = 1e-6) -> str:
    """Barycentric test; false for a degenerate tetrahedron."""
    e1, e2, e3, s = minus(b, a), minus(c, a), minus(d, a), minus(p, a)
    det = det3(e1, e2, e3)
    safe = f"(CASE WHEN abs({det}) < 1e-12 THEN 1.0 ELSE {det} END)"
    u, v, w = f"({det3(s, e2, e3)} / {safe})", f"({det3(e1, s, e3)} / {safe})", f"({det3(e1, e2, s)} / {safe})"
    return f"(abs({det}) >= 1e-12 AND {u} >= {-eps!r} AND {v} >= {-eps!r} AND {w} >= {-eps!r} AND {u} + {v} + {w} <= {1 + eps!r})"


def tetrahedron_volume(a, b, c, d) -> str:
    return f"(abs({det3(minus(b, a), minus(c, a), minus(d, a))}) / 6.0)"


def circumcentre(a, b, c, d) -> tuple[str, str, str]:
    """Centre of the sphere through a, b, c, d. Of flat ones that lie on a circle, the circle's centre; else null."""
    e = [minus(x, a) for x in (b, c, d)]
    sq = [f"({dot(v, v)})" for v in e]
    det = f"(2.0 * {det3(*e)})"
    parts = [cross(e[1], e[2]), cross(e[2], e[0]), cross(e[0], e[1])]
    sphere = [f"(({sq[0]} * {parts[0][k]} + {sq[1]} * {parts[1][k]} + {sq[2]} * {parts[2][k]}) / nullif({det}, 0))" for k in range(3)]
    flat = ["CASE", "CASE", "CASE"]
    for i, j, other in ((1, 2, 0), (2, 0, 1), (0, 1, 2)):  # the circle through a and two more, if the fourth is on it
        n = cross(e[i], e[j])
        n2 = f"({dot(n, n)})"
        u, v = cross(e[j], n), cross(n, e[i])
        o = [f"(({sq[i]} * {u[k]} + {sq[j]} * {v[k]}) / nullif(2.0 * {n2}, 0))" for k in range(3)]
        on = f"abs(2.0 * ({dot(o, e[other])}) - {sq[other]}) <= 1e-9 * greatest({', '.join(sq)})"
        flat = [f"{f} WHEN {n2} <> 0 AND {on} THEN {c}" for f, c in zip(flat, o, strict=True)]
    return tuple(f"(({a[k]}) + CASE WHEN {det} <> 0 THEN {sphere[k]} ELSE {flat[k]} END END)" for k in range(3))


def in_sphere(a, b, c, d, p) -> str:
    """Positive where p is inside the sphere through a, b, c, d (of either orientation)."""
    o = circumcentre(a, b, c, d)
    return f"(({dist2(o, a)}) - ({dist2(o, p)}))"


# --- contacts -------------------------------------------------------------------------------------------------------


def box_contact(low1, high1, low2, high2) -> dict[str, str]:
    """Contact of overlapping boxes: centre of the common box, least overlap, and the first of +X -X +Y -Y +Z -Z with it."""
    point = [f"((greatest(({a}), ({c})) + least(({b}), ({d}))) / 2)" for a, b, c, d in zip(low1, high1, low2, high2, strict=True)]
    pushes = []
    for a, b, c, d in zip(low1, high1, low2, high2, strict=True):
        pushes += [f"(({b}) - ({c}))", f"(({d}) - ({a}))"]
    depth = f"least({', '.join(pushes)})"
    names = ("+X", "-X", "+Y", "-Y", "+Z", "-Z")
    normal = "CASE " + " ".join(f"WHEN {p} = {depth} THEN '{n}'" for p, n in zip(pushes, names, strict=True)) + " END"
    return {"contact_x": point[0], "contact_y": point[1], "contact_z": point[2], "depth": depth, "normal": normal}


def point_contact(a, b, reach: float) -> dict[str, str]:
    d = dist(a, b)
    mid = [f"((({p}) + ({q})) / 2)" for p, q in zip(a, b, strict=True)]
    return {"contact_x": mid[0], "contact_y": mid[1], "contact_z": mid[2], "depth": f"CASE WHEN {d} = 0 THEN 0.0 ELSE {reach!r} - {d} END"}


def point_box_depth(p, low, high) -> str:
    """Distance to the nearest face, negative in the skirt outside."""
    faces = [f"least(({c}) - ({a}), ({b}) - ({c}))" for c, a, b in zip(p, low, high, strict=True)]
    return f"least({', '.join(faces)})"


def segment_point(p, a, b) -> tuple[str, str, str]:
    """The point of segment ab nearest to p."""
    ab = minus(b, a)
    t = clamp(f"({dot(minus(p, a), ab)}) / greatest({dot(ab, ab)}, 1e-300)", "0.0", "1.0")
    return tuple(f"(({q}) + {t} * {v})" for q, v in zip(a, ab, strict=True))


def upright_distance2(a, b, half_a: str, half_b: str) -> str:
    """Squared distance of two segments along z, given by their middles and half lengths."""
    gap = f"greatest(0.0D, abs(({a[2]}) - ({b[2]})) - ({half_a}) - ({half_b}))"
    return f"({dist2(a[:2], b[:2])} + {gap} * {gap})"


def segments_distance2(a, b, c, d) -> str:
    """Squared distance of two segments: the best of the interior solution and the four end-to-segment distances."""
    u, v, w = minus(b, a), minus(d, c), minus(a, c)
    A, B, C, D, E = (f"({dot(x, y)})" for x, y in ((u, u), (u, v), (v, v), (u, w), (v, w)))
    den = f"({A} * {C} - {B} * {B})"
    safe = f"(CASE WHEN {den} < 1e-12 THEN 1.0 ELSE {den} END)"
    s, t = clamp(f"({B} * {E} - {C} * {D}) / {safe}", "0.0", "1.0"), clamp(f"({A} * {E} - {B} * {D}) / {safe}", "0.0", "1.0")
    p, q = tuple(f"(({x}) + {s} * {y})" for x, y in zip(a, u, strict=True)), tuple(f"(({x}) + {t} * {y})" for x, y in zip(c, v, strict=True))
    ends = [dist2(a, segment_point(a, c, d)), dist2(b, segment_point(b, c, d)), dist2(c, segment_point(c, a, b)), dist2(d, segment_point(d, a, b))]
    return f"least({dist2(p, q)}, {', '.join(ends)})"


def impact_time(p, v, r: str) -> str:
    """First t in [0, 1] at which two spheres (relative position p, relative velocity v, radii sum r) touch; null: never."""
    a, b, c = f"({dot(v, v)})", f"(2 * ({dot(p, v)}))", f"(({dot(p, p)}) - ({r}) * ({r}))"
    disc = f"({b} * {b} - 4 * {a} * {c})"
    safe = f"(CASE WHEN {a} < 1e-12 THEN 1.0 ELSE {a} END)"
    first, second = (f"((-{b} {s} sqrt(greatest({disc}, 0.0))) / (2 * {safe}))" for s in "-+")
    return f"CASE WHEN {c} <= 0 THEN 0.0 WHEN {a} < 1e-12 OR {disc} < 0 THEN NULL WHEN {first} >= 0 AND {first} <= 1 THEN {first} WHEN {first} < 0 AND {second} >= 0 AND {second} <= 1 THEN {second} ELSE NULL END"
