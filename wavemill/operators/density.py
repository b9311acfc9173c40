"""Density clustering on mutual reachability, up to a stated reach.

Points of one place meet as one, with their number. Places are dealt into leaves of about BLOCK by median cuts, which are set by a
sample of SAMPLE places a leaf; all places are dealt. A leaf is a task, and a place visits the leaves that its search reaches:

1. The nearest places in its own leaf bound its core distance (that of the k-th other point); it visits the leaves within that
   bound. A point with fewer neighbours within reach has none and is noise.
2. Candidates of the minimum spanning forest under mutual reachability (the largest of both core distances and the distance): the
   directions from a place are parted into cones of at most 60 degrees. Of two places in one cone the heavier edge is the heaviest
   of a triangle, so it isn't in the forest; equal ones are compared by their ids. Each place is searched as far as about SEEN
   places lie in each cone. A cone in which none was found is open: an edge that neither end sees lies in an open cone of both,
   so only places with open cones, those at the rims, meet beyond that, and the nearest in each cone is kept.
3. Contraction: in groups of leaves, then of more of them, each part whose lightest edge stays in its group is merged along it;
   what is left of a group meets the others. Edges are ordered by weight and both ids, so equal weights make no cycle. If more
   than WHOLE edges are left for the last group, Borůvka rounds by joins go on until they fit.
4. Each tree of the forest, which is apart from others by more than reach, is condensed: going from heavy to light edges,
   a component lasts while parts of fewer than ``least`` points fall off, and two parts of ``least`` or more are new
   clusters. Edges of equal weight part at once. The set of clusters with the largest sum of stabilities is kept. A tree's edges
   are in a task, a row per place.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from wavemill.operators.graph import connected
from wavemill.operators.order import written

BLOCK = 512
SAMPLE = 8
SAMPLES = 1 << 17
SEEN = 8
MATRIX = 1 << 21
WHOLE = 1 << 20
TINY = 1e-12


def _cuts(places: DataFrame, xs: list[str], block: int) -> tuple[np.ndarray, np.ndarray]:
    """(axis, cut) by node of a tree of median cuts, its root at 1 and the children of i at 2 i and 2 i + 1."""
    n = places.count()
    leaves = 1 << max(0, min(math.ceil(math.log2(max(n, 1) / block)), int(math.log2(SAMPLES / SAMPLE))))
    few = places.select(*xs)
    v = (few if n <= 2 * block else few.sample(min(1.0, SAMPLE * leaves / n), 1)).toPandas().to_numpy(float) if leaves > 1 else None
    axis, cut, rows = np.zeros(leaves, np.int64), np.zeros(leaves), {1: v}
    for i in range(1, leaves):
        v = rows.pop(i)
        if len(v):
            axis[i] = np.ptp(v, axis=0).argmax()
            cut[i] = np.median(v[:, axis[i]])
        high = v[:, axis[i]] > cut[i]
        rows[2 * i], rows[2 * i + 1] = v[~high], v[high]
    return axis, cut


def _leaves(v: np.ndarray, radius: np.ndarray, axis: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) for all leaves that a cube about each row reaches."""
    row, node = np.arange(len(v)), np.ones(len(v), np.int64)
    while len(node) and node[0] < len(axis):
        x, c, r = v[row, axis[node]], cut[node], radius[row]
        low, high = x - r <= c, x + r > c
        row, node = np.concatenate([row[low], row[high]]), np.concatenate([2 * node[low], 2 * node[high] + 1])
    return row, node - len(axis)


def _dealt(places: DataFrame, xs: list[str], cuts: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """places by leaf, once for each leaf within ``radius``, with the leaf and their home."""

    def deal(parts):
        for p in parts:
            v, r = p[xs].to_numpy(float), p["radius"].to_numpy(float)
            row, leaf = _leaves(v, np.zeros(len(v)), *cuts)
            home = np.empty(len(v), np.int64)
            home[row] = leaf
            row, leaf = _leaves(v, np.where(r > 0, r * (1 + 1e-9) + 1e-12 * np.abs(v).max(axis=1, initial=0.0), 0.0), *cuts)
            yield p.iloc[row].assign(home=home[row], leaf=leaf)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in places.schema)
    tasks = max(1, min(len(cuts[0]) // 4, int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return places.repartition(tasks).mapInPandas(deal, f"{schema}, home long, leaf long").repartition(tasks, "leaf")


def _distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    total = np.zeros((len(p), len(q)))
    for i in range(p.shape[1]):
        total += (p[:, None, i] - q[None, :, i]) ** 2
    return np.sqrt(total)


def _chunks(n: int, m: int):
    step = max(1, MATRIX // max(m, 1))
    return (slice(i, i + step) for i in range(0, n, step))


def core_distances(points: DataFrame, xs: list[str], reach: float, k: int, block: int = BLOCK) -> DataFrame:
    """(id, xs.., core, seen): the distance to the k-th other point, null beyond reach, and how far the forest is searched from here.

    Points that share an id or lack one or a place are left out but for one.
    """
    places, members = _places(points, xs)
    cores = _cores(places, xs, reach, k, _cuts(places, xs, block)).select("home", "core", "seen")
    return members.join(cores, "home", "left").select("id", *xs, "core", "seen")


def _places(points: DataFrame, xs: list[str]) -> tuple[DataFrame, DataFrame]:
    """(home, xs.., n), a row per finite place with its least id and number of points, and (id, xs.., home)."""
    given = points.select("id", *[F.col(x).cast("double").alias(x) for x in xs])
    for c in ("id", *xs):
        given = given.where(F.col(c).isNotNull() & (F.lit(True) if c == "id" else ~F.isnan(c)))
    pts = written(given.groupBy("id").agg(F.min(F.struct(*xs)).alias("_x")).select("id", "_x.*"), "points")
    places = written(pts.groupBy(*xs).agg(F.min("id").alias("home"), F.count(F.lit(1)).alias("n")), "places")
    finite = places
    for x in xs:
        finite = finite.where(F.abs(x) < float("inf"))
    return finite, pts.join(places.drop("n"), xs).select("id", *xs, "home")


def _cores(places: DataFrame, xs: list[str], reach: float, k: int, cuts: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """places with core and seen."""
    rows = places.select(F.col("home").alias("id"), *xs, "n")
    kind = rows.schema["id"].dataType.simpleString()
    fields = f"id {kind}, {', '.join(f'`{x}` double' for x in xs)}, n long, radius double, far array<double>, many array<long>"

    def nearest(alone: bool):
        def run(p: pd.DataFrame) -> pd.DataFrame:
            """The k nearest of the places at home here, to those themselves or to the visitors."""
            at_home = (p["home"] == p["leaf"]).to_numpy()
            own = p[at_home]
            asks = own if alone else p[~at_home] if len(own) else own
            here, there, many = own[xs].to_numpy(float), asks[xs].to_numpy(float), own["n"].to_numpy()
            far, counts, radius = [], [], np.full(len(asks), float(reach))
            for at in _chunks(len(asks), len(own)):
                d = _distances(there[at], here)
                if alone:
                    d[np.arange(len(d)), at.start + np.arange(len(d))] = np.inf
                few = np.argpartition(d, min(k, len(own)) - 1, axis=1)[:, :k]
                d = np.take_along_axis(d, few, 1)
                if d.shape[1] == k:
                    radius[at] = np.minimum(d.max(axis=1), reach)
                fit = (d <= reach) & np.isfinite(d)
                far += [r[t] for r, t in zip(d, fit, strict=True)]
                counts += [many[j[t]] for j, t in zip(few, fit, strict=True)]
            out = asks[["id", *xs, "n"]].assign(radius=radius)
            out["far"], out["many"] = pd.Series(far, out.index, object), pd.Series(counts, out.index, object)
            return out

        return run

    alone = _dealt(rows.withColumn("radius", F.lit(0.0)), xs, cuts).groupBy("leaf").applyInPandas(nearest(True), fields)
    alone = written(alone, "nearest")
    met = _dealt(alone.drop("far", "many"), xs, cuts).groupBy("leaf").applyInPandas(nearest(False), fields)
    near = F.arrays_zip("far", "many").alias("near")
    found = alone.select("id", near).unionByName(met.select("id", near)).groupBy("id")
    found = found.agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    start = F.struct((F.col("n") - 1).alias("seen"), F.when(F.col("n") > k, F.lit(0.0)).alias("core"))
    more = lambda s, v: F.struct((s["seen"] + v["many"]).alias("seen"), F.coalesce(s["core"], F.when(s["seen"] + v["many"] >= k, v["far"])).alias("core"))
    core = F.aggregate("near", start, more)["core"]
    wider = max(1.0, (SEEN * _cones(len(xs)) / k) ** (1 / len(xs)))
    seen = F.coalesce(F.least(wider * F.get("near", F.lit(k - 1))["far"], F.lit(float(reach))), F.lit(float(reach)))
    return written(rows.join(found, "id").select(F.col("id").alias("home"), *xs, "n", core.alias("core"), seen.alias("seen")), "cores")


def _cones(axes: int) -> int:
    return axes << axes


def _cone(v: np.ndarray) -> np.ndarray:
    """A number for the direction of each row: its longest axis and all signs."""
    axes = v.shape[1]
    return (np.abs(v).argmax(axis=1) << axes) + ((v >= 0) << np.arange(axes)).sum(axis=1)


def _sights(places: DataFrame, xs: list[str], reach: float, cuts: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(a, b, w, ga, gb, closed): candidates that either end sees, with closed -1, and for each place and leaf (a, a) with the bits of its closed cones."""
    kind, cones = places.schema["home"].dataType.simpleString(), _cones(len(xs))

    def local(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("id")
        v, core, radius, ids, home = p[xs].to_numpy(float), p["core"].to_numpy(), p["radius"].to_numpy(), p["id"].to_numpy(), p["home"].to_numpy()
        own, closed, parts = np.flatnonzero(home == p["leaf"].to_numpy()), np.zeros(len(p), np.int64), []
        for at in _chunks(len(p), len(own)):
            d = _distances(v[at], v[own])
            i, j = np.nonzero(d <= radius[at][:, None])
            d, i, j = d[i, j], i + at.start, own[j]
            w = np.maximum(d, np.maximum(core[i], core[j]))
            fit = (i != j) & (w <= reach)
            i, j, w = i[fit], j[fit], w[fit]
            c, low, high = _cone(v[j] - v[i]), np.minimum(i, j), np.maximum(i, j)
            order = np.lexsort((high, low, w, i * cones + c))
            i, j, w, c, low, high = (x[order] for x in (i, j, w, c, low, high))
            first = np.ones(len(i), bool)
            first[1:] = (i[1:] != i[:-1]) | (c[1:] != c[:-1])
            lightest = j[np.flatnonzero(first)[np.cumsum(first) - 1]]
            third = np.zeros(len(i))
            for x in range(len(xs)):
                third += (v[lightest, x] - v[j, x]) ** 2
            third = np.maximum(np.sqrt(third), np.maximum(core[lightest], core[j]))
            least, most = np.minimum(lightest, j), np.maximum(lightest, j)
            heaviest = ~first & ((third < w) | ((third == w) & ((least < low) | ((least == low) & (most < high)))))
            shut = first & (w <= radius[i])
            np.bitwise_or.at(closed, i[shut], 1 << c[shut])
            low, high, w = low[~heaviest], high[~heaviest], w[~heaviest]
            parts.append(pd.DataFrame({"a": ids[low], "b": ids[high], "w": w, "ga": home[low], "gb": home[high], "closed": np.int64(-1)}))
        parts.append(pd.DataFrame({"a": ids, "b": ids, "w": 0.0, "ga": home, "gb": home, "closed": closed}))
        return pd.concat(parts)

    rows = places.select(F.col("home").alias("id"), *xs, "core", F.col("seen").alias("radius"))
    return written(_dealt(rows, xs, cuts).groupBy("leaf").applyInPandas(local, f"a {kind}, b {kind}, w double, ga long, gb long, closed long"), "sights")


def _rims(places: DataFrame, xs: list[str], reach: float, sights: DataFrame) -> DataFrame:
    """(a, b, w, ga, gb): candidates that neither end sees, the nearest in an open cone of both."""
    axes, cones, within = len(xs), _cones(len(xs)), F.lit(float(reach))
    open_ = F.bit_or("closed").bitwiseXOR(F.lit((1 << cones) - 1))
    masks = sights.where("closed >= 0").groupBy(F.col("a").alias("home")).agg(open_.alias("open"), F.first("ga").alias("g")).where("open <> 0")
    rims = written(places.where(F.col("seen") < reach).join(masks, "home").select(F.col("home").alias("id"), *xs, F.col("seen").alias("r"), "open", "g"), "rims")
    bit = lambda mask, n: F.expr(f"(shiftright({mask}, cast({n} as int)) & 1) = 1")
    out = None
    for f in range(axes):
        sides = []
        for s, up in (("a", 1), ("b", 0)):
            mask = sum(1 << ((f << axes) + c) for c in range(1 << axes) if c >> f & 1 == up)
            side = rims.where(F.col("open").bitwiseAND(F.lit(mask)) != 0)
            side = side.select(F.col("id").alias(s), F.col("r").alias(f"r{s}"), F.col("open").alias(f"o{s}"), F.col("g").alias(f"g{s}"), *[F.col(x).alias(f"{s}{i}") for i, x in enumerate(xs)])
            ends = [e for i in range(axes) for e in (F.min(f"{s}{i}").alias(f"{s}min{i}"), F.max(f"{s}{i}").alias(f"{s}max{i}"))]
            sides.append((side, side.groupBy(f"g{s}").agg(*ends)))
        (a, boxes), (b, others) = sides
        near = boxes.join(F.broadcast(others), F.expr(f"bmax{f} >= amin{f}") & (F.expr(f"bmin{f} - amax{f}") <= within))  # a row per leaf
        for i in set(range(axes)) - {f}:
            gap = f"greatest(amin{i} - bmax{i}, bmin{i} - amax{i})"
            near = near.where((F.expr(gap) <= within) & F.expr(f"{gap} <= (bmax{f} - amin{f}) * (1 + 1e-9)"))
        met = near.select("ga", "gb").join(a, "ga").join(b, "gb")
        for i in range(axes):
            met = met.withColumn(f"d{i}", F.col(f"b{i}") - F.col(f"a{i}"))
        met = met.where(" AND ".join([f"d{f} > 0", *[f"d{f} {'>' if i < f else '>='} abs(d{i})" for i in range(axes) if i != f]]))
        met = met.withColumn("w", F.expr(f"sqrt({' + '.join(f'd{i} * d{i}' for i in range(axes))})")).where((F.col("w") <= within) & F.expr("w > ra AND w > rb"))
        for s, sign in (("a", ">="), ("b", "<=")):
            met = met.withColumn(f"c{s}", F.expr(" + ".join([str(f << axes), *[f"if(d{i} {sign} 0, {1 << i}, 0)" for i in range(axes)]]))).where(bit(f"o{s}", f"c{s}"))
        met = met.select("a", "b", "w", "ga", "gb", "ca", "cb")
        out = met if out is None else out.unionByName(met)
    out = written(out, "unseen")
    ends = out.select(F.col("a").alias("id"), F.col("ca").alias("c"), "w").unionByName(out.select(F.col("b").alias("id"), F.col("cb").alias("c"), "w"))
    ends = written(ends.groupBy("id", "c").agg(F.min("w").alias("low")), "nearest")
    for s in "ab":
        out = out.join(ends.toDF(s, f"c{s}", f"l{s}"), [s, f"c{s}"]).where(f"w = l{s}")
    low, high = [F.struct(F.col(s).alias("a"), F.col(f"g{s}").alias("g")) for s in "ab"]
    return out.select(F.least(low, high).alias("p"), F.greatest(low, high).alias("q"), "w").select(F.col("p.a"), F.col("q.a").alias("b"), "w", F.col("p.g").alias("ga"), F.col("q.g").alias("gb"))


def spanning_edges(d: np.ndarray, reach: float) -> list[tuple[int, int, float]]:
    """Minimum spanning forest of a matrix of weights under ``reach``, ties by the smaller and then the larger index."""
    n = len(d)
    best, code, left, out = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool), []
    at, index = 0, np.arange(n)
    for _ in range(n):
        left[at] = False
        mine = np.minimum(at, index) * n + np.maximum(at, index)
        nearer = left & ((d[at] < best) | ((d[at] == best) & (mine < code))) & (d[at] <= reach)
        best[nearer], code[nearer] = d[at][nearer], mine[nearer]
        open_ = np.where(left, best, np.inf)
        low = open_.min()
        if np.isinf(low):
            rest = np.flatnonzero(left)
            if not len(rest):
                break
            at = int(rest[0])
            continue
        tied = np.flatnonzero(open_ == low)
        at = int(tied[code[tied].argmin()])
        out.append((int(code[at] // n), int(code[at] % n), float(low)))
    return out


def _merged(edges: DataFrame, shift: int) -> DataFrame:
    """(x, y, w, leaf): chosen edges with leaf -1, and (part, what it became, 0, leaf of that), for edges (a, b, w, u, v, gu, gv) between parts u and v."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(key, p: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((*np.split(np.unique(np.concatenate([p["b"], p["a"]]), return_inverse=True)[1], 2), p["w"].to_numpy()))
        p = p.iloc[order]
        names, ends = np.unique(np.concatenate([p["u"], p["v"]]), return_inverse=True)
        u, v = np.split(ends, 2)
        n, m = len(names), len(p)
        leaf = np.zeros(n, np.int64)
        leaf[u], leaf[v] = p["gu"], p["gv"]
        inside, part, live, chosen = leaf >> shift == key[0], np.arange(n), np.arange(m), []
        while True:
            live = live[part[u[live]] != part[v[live]]]
            lightest = np.full(n, m)
            np.minimum.at(lightest, part[u[live]], live)
            np.minimum.at(lightest, part[v[live]], live)
            mine = np.flatnonzero(inside & (lightest < m))
            edge = lightest[mine]
            x, y = part[u[edge]], part[v[edge]]
            both = inside[x] & inside[y]
            if not both.any():
                break
            up = np.arange(n)
            up[mine[both]] = (x + y)[both] - mine[both]
            twins = (up[up] == np.arange(n)) & (np.arange(n) < up)
            up[twins] = np.flatnonzero(twins)
            while (up[up] != up).any():
                up = up[up]
            part = up[part]
            chosen.append(edge[both])
        edge = np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, np.int64)
        got = p.iloc[edge]
        got = pd.DataFrame({"x": got["a"].to_numpy(), "y": got["b"].to_numpy(), "w": got["w"].to_numpy(), "leaf": np.int64(-1)})
        became = part[inside]
        return pd.concat([got, pd.DataFrame({"x": names[inside], "y": names[became], "w": 0.0, "leaf": leaf[became]})])

    groups = F.explode(F.array_distinct(F.array(F.shiftright("gu", shift), F.shiftright("gv", shift))))
    return written(edges.withColumn("_g", groups).groupBy("_g").applyInPandas(run, f"x {kind}, y {kind}, w double, leaf long"), "merged")


def _joined(edges: DataFrame) -> DataFrame:
    """_merged for all parts, by joins."""
    ends = edges.unionByName(edges.withColumns({"u": F.col("v"), "v": F.col("u")}))
    light = written(ends.groupBy("u").agg(F.min(F.struct("w", "a", "b", "v")).alias("m")).select("m.a", "m.b", "m.w", "u", "m.v"), "light")
    chosen = light.select(F.col("a").alias("x"), F.col("b").alias("y"), "w", F.lit(-1).cast("long").alias("leaf")).distinct()
    names = connected(light, "u", "v").select(F.col("node").alias("x"), F.col("component").alias("y"), F.lit(0.0).alias("w"), F.lit(0).cast("long").alias("leaf"))
    return written(chosen.unionByName(names), "merged")


def _forest(places: DataFrame, xs: list[str], reach: float, cuts: tuple[np.ndarray, np.ndarray], whole: int = WHOLE) -> tuple[DataFrame, DataFrame]:
    """(a, b, w): edges of the forest, and (a, tree) for each place."""
    sights = _sights(places, xs, reach, cuts)
    edges = sights.where("closed < 0").drop("closed").unionByName(_rims(places, xs, reach, sights))
    edges = written(edges.select("a", "b", "w", F.col("a").alias("u"), F.col("b").alias("v"), F.col("ga").alias("gu"), F.col("gb").alias("gv")), "edges")
    forest, trees, shift = edges.limit(0).select("a", "b", "w"), places.select(F.col("home").alias("a"), F.col("home").alias("tree")), 3
    while not edges.isEmpty():
        large = 1 << shift >= len(cuts[0]) and edges.count() > whole
        got = _joined(edges) if large else _merged(edges, shift)
        forest = forest.unionByName(got.where("leaf < 0").select(F.col("x").alias("a"), F.col("y").alias("b"), "w"))
        names = got.where("leaf >= 0").select("x", "y", "leaf")
        trees = trees.join(names.select(F.col("x").alias("tree"), "y"), "tree", "left").select("a", F.coalesce("y", "tree").alias("tree"))
        edges = edges.select("a", "b", "w", "u", "v").join(names.toDF("u", "_u", "gu"), "u").join(names.toDF("v", "_v", "gv"), "v").where("_u <> _v")
        ends = [F.struct(F.col("_u").alias("n"), F.col("gu").alias("g")), F.struct(F.col("_v").alias("n"), F.col("gv").alias("g"))]
        edges = edges.groupBy(F.least(*ends).alias("_p"), F.greatest(*ends).alias("_q")).agg(F.min(F.struct("w", "a", "b")).alias("m"))
        fields = [F.col("_p.n").alias("u"), F.col("_q.n").alias("v"), F.col("_p.g").alias("gu"), F.col("_q.g").alias("gv")]
        edges, shift = written(edges.select("m.a", "m.b", "m.w", *fields), "edges"), shift + 4
    return written(forest, "forest"), written(trees, "trees")


def mutual_forest(cores: DataFrame, xs: list[str], reach: float, block: int = BLOCK, whole: int = WHOLE) -> DataFrame:
    """(a, b, w): edges of the minimum spanning forest under mutual reachability up to reach; points of one place hang on the least of them."""
    dense = cores.where("core IS NOT NULL")
    places = written(dense.groupBy(*xs).agg(F.min("id").alias("home"), F.first("core").alias("core"), F.first("seen").alias("seen")), "places")
    forest, _ = _forest(places, xs, reach, _cuts(places, xs, block), whole)
    copies = dense.join(places.select(*xs, "home"), xs).where("id <> home").select(F.col("home").alias("a"), F.col("id").alias("b"), F.col("core").alias("w"))
    return forest.unionByName(copies)


def condensed(a: np.ndarray, b: np.ndarray, w: np.ndarray, many: dict, least: int, reach: float, epsilon: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, label, strength) of a tree given by its edges: label is the least place of its cluster, or -1 (index) for noise.

    ``many`` has (points, core distance) of places with more than one point, which part at that distance. Strength is how far a
    point lasts in its cluster, 1 for the longest. Weights count as TINY at least; edges of equal weight part at once. Of a cluster and
    what came of it, the one of larger stability is kept, the cluster itself if both are equal.
    """
    points, ends = np.unique(np.concatenate([a, b, np.array(list(many), dtype=a.dtype)]), return_inverse=True)
    n = len(points)
    left, right = ends[: len(a)], ends[len(a) : 2 * len(a)]
    order = np.lexsort((right, left, w))
    left, right = left[order].tolist(), right[order].tolist()
    rate = np.full(2 * n - 1, np.inf)
    size = np.ones(2 * n - 1, np.int64)
    for i, (count, core) in zip(ends[2 * len(a) :], many.values(), strict=True):
        size[i], rate[i] = count, 1 / max(core, TINY)
    rate[n:] = 1 / np.maximum(w[order], TINY)
    rate, size, up, child = rate.tolist(), size.tolist(), list(range(2 * n - 1)), [(-1, -1)] * (2 * n - 1)
    width = [1] * (2 * n - 1)  # places

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for k in range(n - 1):
        x, y, j = root(left[k]), root(right[k]), n + k
        child[j], size[j], width[j] = (x, y), size[x] + size[y], width[x] + width[y]
        up[x] = up[y] = j
    start, line = [0] * (2 * n - 1), np.zeros(n, np.int64)  # each part is a stretch of the line
    for j in range(2 * n - 2, n - 1, -1):
        x, y = child[j]
        start[x], start[y] = start[j], start[j] + width[x]
    line[start[:n]] = np.arange(n)

    home_of, last = np.full(n, -1), np.zeros(n)
    if size[2 * n - 2] < least:
        return points, home_of, last
    birth, stable, above = [1 / reach], [0.0], [-1]

    def leaves(j: int, c: int, at: float) -> None:
        here = line[start[j] : start[j] + width[j]]
        home_of[here], last[here] = c, at

    stack = [(2 * n - 2, 0)]
    while stack:
        i, c = stack.pop()
        at = rate[i]
        if i < n:
            leaves(i, c, at)
            stable[c] += size[i] * (at - birth[c]) if size[i] > 1 else 0.0
            continue
        grown, parts = [], list(child[i])
        while parts:
            j = parts.pop()
            if size[j] < least or (j < n and rate[j] <= at):
                leaves(j, c, at)
            elif rate[j] <= at:
                parts += child[j]
            else:
                grown.append(j)
        kept = size[grown[0]] if len(grown) == 1 else 0
        stable[c] += (size[i] - kept) * (at - birth[c])
        if len(grown) == 1:
            stack.append((grown[0], c))
            continue
        for j in grown:
            birth.append(at), stable.append(0.0), above.append(c)
            stack.append((j, len(birth) - 1))
    best, kept = list(stable), [True] * len(birth)
    below: list[list[int]] = [[] for _ in birth]
    for c in range(len(birth) - 1, -1, -1):
        if below[c] and sum(best[k] for k in below[c]) > stable[c]:
            best[c], kept[c] = sum(best[k] for k in below[c]), False
        if above[c] >= 0:
            below[above[c]].append(c)
    home = np.full(len(birth), -1)
    for c in range(len(birth)):  # parents come first
        top = home[above[c]] if above[c] >= 0 else -1
        home[c] = top if top >= 0 else (c if kept[c] or (epsilon and all(1 / birth[k] < epsilon for k in below[c])) else -1)
    label = home[home_of]
    in_one = label >= 0
    top = np.zeros(len(birth))
    np.maximum.at(top, label[in_one], np.where(np.isfinite(last), last, 0.0)[in_one])
    first = np.full(len(birth), n)
    np.minimum.at(first, label[in_one], np.flatnonzero(in_one))
    strength = np.zeros(n)
    most = top[label[in_one]]
    strength[in_one] = np.where(most > 0, np.minimum(last[in_one] / np.where(most > 0, most, 1.0), 1.0), 1.0)
    return points, np.where(in_one, first[label], -1), strength


def cluster(points: DataFrame, id: str, xs: list[str], *, reach: float, samples: int = 25, least: int = 25, epsilon: float = 0.0, block: int = BLOCK) -> DataFrame:
    """(id, cluster, strength): ``cluster`` is the least id of the point's cluster, null for noise.

    ``samples`` other points set the core distance, clusters have ``least`` points or more, and clusters that part below
    ``epsilon`` stay one. Groups further apart than ``reach`` are never one cluster; for points closer than that the labels are
    those of the whole tree. Rows without an id or a place are absent; of rows that share an id one counts. Up to three axes.
    """
    axes = [f"_at{i}" for i in range(len(xs))]
    places, members = _places(points.select(F.col(id).alias("id"), *[F.col(x).alias(a) for x, a in zip(xs, axes, strict=True)]), axes)
    cuts = _cuts(places, axes, block)
    dense = _cores(places, axes, float(reach), samples, cuts).where("core IS NOT NULL")
    forest, trees = _forest(dense, axes, float(reach), cuts)
    copies = dense.where("n > 1").select(F.col("home").alias("a"), F.col("home").alias("b"), F.col("core").alias("w"), "n")
    rows = written(forest.withColumn("n", F.lit(1).cast("long")).unionByName(copies).join(trees, "a"), "rows")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        alone = (p["a"] == p["b"]).to_numpy()
        own, p = p[alone], p[~alone]
        many = {a: (n, w) for a, n, w in zip(own["a"], own["n"], own["w"], strict=True)}
        name, label, strength = condensed(p["a"].to_numpy(), p["b"].to_numpy(), p["w"].to_numpy(), many, least, reach, epsilon)
        return pd.DataFrame({"home": name, "cluster": pd.Series([name[k] if k >= 0 else None for k in label], dtype=object), "strength": strength})

    kind = places.schema["home"].dataType.simpleString()
    points_of = F.sum(F.when(F.col("a") == F.col("b"), F.col("n") - 1).otherwise(1)) + 1
    large = rows.groupBy("tree").agg(points_of.alias("n")).where(F.col("n") >= least).select("tree")
    labels = written(rows.join(large, "tree").groupBy("tree").applyInPandas(run, f"home {kind}, cluster {kind}, strength double"), "labels")
    return members.join(labels, "home", "left").select(F.col("id").alias(id), "cluster", F.coalesce("strength", F.lit(0.0)).alias("strength"))
