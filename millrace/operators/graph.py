"""Graph operators over edges (src, dst, w). Loops over DataFrames write each round's state once and stop when it settles.

Ties are settled by the smallest id. Vertices that cannot be reached are absent from results unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.components import connected_components
from millrace.plans.storage import cut

ROUNDS = 200


def both_ways(edges: DataFrame) -> DataFrame:
    """An undirected graph's edges in both directions."""
    return edges.unionByName(transpose(edges)).distinct()


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(c for c in edges.columns if c not in ("src", "dst")))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """id, out_degree, in_degree."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def neighbours(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "w"))).alias("neighbours"))


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) with a < b < c, each pair joined by an edge in either direction. Edges point from the end of lower degree, so a hub does not pair all its neighbours."""
    e = edges.where("src != dst").select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct()
    d = e.select(F.col("x").alias("id")).union(e.select("y")).groupBy("id").count()
    e = e.join(d.select(F.col("id").alias("x"), F.col("count").alias("dx")), "x").join(d.select(F.col("id").alias("y"), F.col("count").alias("dy")), "y")
    up = cut(e.select(F.when(F.struct("dx", "x") < F.struct("dy", "y"), F.col("x")).otherwise(F.col("y")).alias("lo"), F.when(F.struct("dx", "x") < F.struct("dy", "y"), F.col("y")).otherwise(F.col("x")).alias("hi")))
    wedge = up.alias("p").join(up.alias("q"), (F.col("p.lo") == F.col("q.lo")) & (F.col("p.hi") < F.col("q.hi"))).select(F.col("p.lo").alias("u"), F.col("p.hi").alias("v"), F.col("q.hi").alias("w"))
    closing = up.select(F.least("lo", "hi").alias("v"), F.greatest("lo", "hi").alias("w"))
    return wedge.join(closing, ["v", "w"]).select(F.array_sort(F.array("u", "v", "w")).alias("t")).select(F.col("t")[0].alias("a"), F.col("t")[1].alias("b"), F.col("t")[2].alias("c"))


def _settle(state: DataFrame, step: Callable[[DataFrame], DataFrame], measure, rounds: int = ROUNDS) -> DataFrame:
    """Repeat until the measure of the state stays the same."""
    state = cut(state)
    seen = state.agg(*measure).first()
    for _ in range(rounds):
        state = cut(step(state))
        now = state.agg(*measure).first()
        if now == seen:
            return state
        seen = now
    raise RuntimeError(f"not settled in {rounds} rounds")


def bfs(edges: DataFrame, start: int) -> DataFrame:
    """id, distance in hops, and the smallest parent one hop nearer (null for the start). Only the newest layer is joined with edges."""
    spark = edges.sparkSession
    layer = cut(spark.createDataFrame([(start, 0, None)], "id long, distance long, parent long"))
    done = layer
    for hop in range(1, ROUNDS):
        nxt = edges.join(layer.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        layer = cut(nxt.join(done.select("id"), "id", "left_anti").select("id", F.lit(hop).cast("long").alias("distance"), "parent"))
        if layer.isEmpty():
            return done
        done = cut(done.union(layer))
    raise RuntimeError("graph is deeper than the rounds allow")


def shortest_paths(edges: DataFrame, start: int, negative: bool = False) -> DataFrame:
    """id, distance, parent from one vertex. Negative weights are refused unless asked for; then a negative cycle that can be reached raises."""
    if not negative and edges.where("w < 0").limit(1).count():
        raise ValueError("negative weight")
    spark = edges.sparkSession
    best = spark.createDataFrame([(start, 0.0)], "id long, distance double")
    e = cut(edges.groupBy("src", "dst").agg(F.min("w").cast("double").alias("w")))
    n = vertices(e).count()

    def step(state):
        via = e.join(state.select(F.col("id").alias("src"), "distance"), "src").select(F.col("dst").alias("id"), (F.col("distance") + F.col("w")).alias("distance"))
        return state.unionByName(via).groupBy("id").agg(F.min("distance").alias("distance"))

    try:
        dist = _settle(best, step, [F.count("*"), F.sum("distance")], min(ROUNDS, n + 1))
    except RuntimeError:
        if negative and n < ROUNDS:
            raise ValueError("negative cycle") from None
        raise
    a, b = dist.select(F.col("id").alias("src"), F.col("distance").alias("d1")), dist.select(F.col("id").alias("dst"), F.col("distance").alias("d2"))
    tight = e.join(a, "src").join(b, "dst").where(F.abs(F.col("d1") + F.col("w") - F.col("d2")) < 1e-9).where(F.col("dst") != start)
    return dist.join(tight.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent")), "id", "left")


def path_to(paths: DataFrame, goal: int, most: int = 10_000) -> list[int]:
    """The path of parents to a goal, asked for a vertex at a time; empty if the goal is not reached."""
    if paths.where(F.col("id") == goal).isEmpty():
        return []
    out, now = [goal], goal
    while (row := paths.where(F.col("id") == now).select("parent").first()) and row[0] is not None and len(out) < most:
        now = row[0]
        out.append(now)
    return out[::-1]


def all_pairs(edges: DataFrame, most: int = 2000) -> DataFrame:
    """src, dst, distance for all pairs by repeated squaring; for graphs of at most ``most`` vertices, which is checked. Of parallel edges the lightest counts."""
    v = vertices(edges)
    if v.limit(most + 1).count() > most:
        raise ValueError(f"all pairs of more than {most} vertices")
    own = v.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("distance"))
    first = own.union(edges.select("src", "dst", F.col("w").cast("double"))).groupBy("src", "dst").agg(F.min("distance").alias("distance"))

    def step(d):
        left, right = d.select("src", F.col("dst").alias("mid"), F.col("distance").alias("d1")), d.select(F.col("src").alias("mid"), "dst", F.col("distance").alias("d2"))
        return left.join(right, "mid").groupBy("src", "dst").agg(F.min(F.col("d1") + F.col("d2")).alias("distance"))

    return _settle(first, step, [F.count("*"), F.sum("distance")])


def topological_layers(edges: DataFrame) -> DataFrame:
    """id and layer: vertices without predecessors are layer 0, others one after their last predecessor. A cycle raises."""
    v = vertices(edges)
    left, layer, done = cut(edges.select("src", "dst")), 0, None
    rest = cut(v)
    while not rest.isEmpty():
        free = cut(rest.join(left.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").withColumn("layer", F.lit(layer)))
        if free.isEmpty():
            raise ValueError("the graph has a cycle")
        done = free if done is None else done.union(free)
        rest = cut(rest.join(free, "id", "left_anti"))
        left = cut(left.join(free.select(F.col("id").alias("src")), "src", "left_anti"))
        layer += 1
    return done if done is not None else v.withColumn("layer", F.lit(0))


def cycle_vertices(edges: DataFrame) -> DataFrame:
    """Vertices that a topological sort cannot place: those on cycles and behind them."""
    left = cut(edges.select("src", "dst"))
    while True:
        free = left.select(F.col("src").alias("id")).distinct().join(left.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
        nxt = cut(left.join(free.select(F.col("id").alias("src")), "src", "left_anti"))
        if nxt.count() == left.count():
            return left.select(F.col("dst").alias("id")).distinct()
        left = nxt


def components(edges: DataFrame) -> DataFrame:
    """vertex and the smallest vertex of its component."""
    return connected_components(edges)


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Edges of a minimum spanning forest, by rounds in which every component takes its lightest edge; ties by (w, src, dst)."""
    e = cut(edges.where("src != dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w").groupBy("src", "dst").agg(F.min("w").alias("w")))
    label = cut(vertices(e).withColumn("comp", F.col("id")))
    chosen = e.limit(0)
    for _ in range(64):
        a, b = label.select(F.col("id").alias("src"), F.col("comp").alias("ca")), label.select(F.col("id").alias("dst"), F.col("comp").alias("cb"))
        across = cut(e.join(a, "src").join(b, "dst").where("ca != cb"))
        if across.isEmpty():
            return chosen
        key = F.struct("w", "src", "dst")
        best = across.select(F.col("ca").alias("comp"), key.alias("k")).union(across.select("cb", key)).groupBy("comp").agg(F.min("k").alias("k"))
        new = best.select("k.src", "k.dst", "k.w").distinct()
        chosen = cut(chosen.unionByName(new))
        joined = connected_components(chosen)
        label = cut(label.select("id").join(joined.select(F.col("vertex").alias("id"), "component"), "id", "left").select("id", F.coalesce("component", "id").alias("comp")))
    raise RuntimeError("spanning forest did not settle")


def strong_components(edges: DataFrame) -> DataFrame:
    """vertex and the smallest vertex of its strongly connected component.

    Forward labels spread the smallest id along edges; a label's own vertex then gathers, against the edges, those of its
    label that reach it. What is gathered leaves the graph, and the rest starts again.
    """
    e, out = cut(edges.select("src", "dst").where("src != dst").distinct()), None
    rest = cut(vertices(edges.select("src", "dst")))
    while not rest.isEmpty():
        first = rest.select("id", F.col("id").alias("label"))

        def spread(state, along=e):
            via = along.join(state.select(F.col("id").alias("src"), "label"), "src").select(F.col("dst").alias("id"), "label")
            return state.unionByName(via).groupBy("id").agg(F.min("label").alias("label"))

        label = _settle(first, spread, [F.sum(F.xxhash64("id", "label").cast("decimal(20,0)"))])
        a, b = label.select(F.col("id").alias("src"), F.col("label").alias("la")), label.select(F.col("id").alias("dst"), F.col("label").alias("lb"))
        inside = cut(e.join(a, "src").join(b, "dst").where("la = lb").select("src", "dst"))
        roots = label.where("id = label").select("id", F.col("label").alias("root"))

        def gather(state, back=inside):
            via = back.join(state.select(F.col("id").alias("dst"), "root"), "dst").select(F.col("src").alias("id"), "root")
            return state.unionByName(via).distinct()

        got = _settle(roots, gather, [F.count("*")])
        found = got.select(F.col("id").alias("vertex"), F.col("root").alias("component"))
        out = found if out is None else cut(out.union(found))
        rest = cut(rest.join(got.select("id"), "id", "left_anti"))
        keep = rest.select("id")
        e = cut(e.join(keep.select(F.col("id").alias("src")), "src", "left_semi").join(keep.select(F.col("id").alias("dst")), "dst", "left_semi"))
    return out


def page_rank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    e = cut(edges.select("src", "dst").distinct())
    v = cut(vertices(e))
    n = v.count()
    out = e.groupBy("src").agg(F.count("*").alias("d"))
    rank = v.withColumn("rank", F.lit(1.0 / n))
    for k in range(rounds):
        flow = e.join(out, "src").join(rank.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("d")).alias("got"))
        rank = v.join(flow, "id", "left").select("id", ((1 - damping) / n + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if k % 5 == 4:
            rank = cut(rank)
    return rank


def eulerian(edges: DataFrame) -> DataFrame:
    """For a directed graph: whether it has an Eulerian path, and circuit (balance of degrees and one component)."""
    d = degrees(edges).withColumn("b", F.col("out_degree") - F.col("in_degree"))
    starts, ends, odd = d.agg(F.count_if(F.col("b") == 1), F.count_if(F.col("b") == -1), F.count_if(F.abs("b") > 1)).first()
    one = connected_components(edges.select("src", "dst")).select("component").distinct().count() <= 1
    circuit = one and not odd and starts == ends == 0
    return edges.sparkSession.createDataFrame([(bool(circuit or (one and not odd and starts == ends == 1)), bool(circuit))], "path boolean, circuit boolean")


def bipartite_sides(edges: DataFrame) -> DataFrame:
    """id and side (0 or 1, the smallest vertex of a component on 0); raises if an edge joins a side to itself."""
    double = edges.select(F.concat_ws(":", "src", F.lit(0)).alias("src"), F.concat_ws(":", "dst", F.lit(1)).alias("dst")).union(edges.select(F.concat_ws(":", "src", F.lit(1)), F.concat_ws(":", "dst", F.lit(0))))
    comp = cut(connected_components(double))
    part = comp.select(F.split("vertex", ":")[0].cast("long").alias("id"), F.split("vertex", ":")[1].cast("int").alias("c"), "component")
    sides = part.groupBy("id").agg(F.min(F.struct("component", "c")).alias("m"), F.countDistinct("component").alias("n"))
    if not sides.where("n < 2").isEmpty():
        raise ValueError("not bipartite")
    least = part.join(sides.select("id", F.col("m.component").alias("component")), ["id", "component"])
    base = least.groupBy("component").agg(F.min_by("c", "id").alias("c0"))
    return least.join(base, "component").select("id", F.when(F.col("c") == F.col("c0"), 0).otherwise(1).alias("side"))


def greedy_colours(edges: DataFrame, most: int = 100_000) -> DataFrame:
    """id and colour, first fit by descending degree (then id), in a kernel for graphs of at most ``most`` edges, which is checked."""
    return _kernel(edges, _colour, "id long, colour int", most)


def _colour(rows):
    near: dict = {}
    for a, b, _ in rows:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    colour: dict = {}
    for v in sorted(near, key=lambda v: (-len(near[v]), v)):
        used = {colour[u] for u in near[v] if u in colour}
        colour[v] = next(c for c in range(len(near) + 1) if c not in used)
    return sorted(colour.items())


def _kernel(edges: DataFrame, run: Callable, schema: str, most: int) -> DataFrame:
    """Apply a plain function to all edges in one task; their number is checked first."""
    import pandas as pd

    e = edges.select("src", "dst", *(["w"] if "w" in edges.columns else [F.lit(1.0).alias("w")]))
    if e.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} edges")
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    return e.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda k, pdf: pd.DataFrame(run(sorted(pdf[["src", "dst", "w"]].itertuples(index=False, name=None))), columns=names), schema)


#: Edges that one task reduces to forests.
SHARE = 500_000


def _arcs(pdf):
    """Vertices of rows (u, v), and by the vertex's number where its arcs start, where they lead and the row of each; eight bytes a number."""
    from array import array

    import numpy as np

    ids, code = np.unique(np.concatenate([pdf["u"].to_numpy(), pdf["v"].to_numpy()]), return_inverse=True)
    m = len(pdf)
    back, row = np.concatenate([code[m:], code[:m]]), np.tile(np.arange(m), 2)
    by = np.argsort(code, kind="stable")
    return ids, *(array("q", x.astype("int64").tobytes()) for x in (np.searchsorted(code[by], np.arange(len(ids) + 1)), back[by], row[by]))


def _whole(batches):
    import pandas as pd

    rows = [b for b in batches if len(b)]
    return pd.concat(rows, ignore_index=True) if rows else None


def _two_forests(batches):
    """Of a task's edges a breadth-first forest and a forest of the rest.

    They do for bridges and cut vertices, whatever edges are added: without any one vertex, or any one edge, the two forests
    connect the same vertices as all edges do (Eppstein, Galil, Italiano, Nissenzweig: Sparsification, 1997).
    """
    import numpy as np

    if (pdf := _whole(batches)) is None:
        return
    ids, start, to, row = _arcs(pdf)
    kept, seen, up = bytearray(len(pdf)), bytearray(len(ids)), list(range(len(ids)))
    for root in range(len(ids)):
        layer = [] if seen[root] else [root]
        seen[root] = 1
        while layer:
            after = []
            for x in layer:
                for k in range(start[x], start[x + 1]):
                    if not seen[to[k]]:
                        seen[to[k]] = kept[row[k]] = 1
                        after.append(to[k])
            layer = after
    first = bytes(kept)

    def top(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for x in range(len(ids)):
        for k in range(start[x], start[x + 1]):
            if not first[row[k]] and (a := top(x)) != (b := top(to[k])):
                up[a] = b
                kept[row[k]] = 1
    yield pdf[np.frombuffer(kept, "bool")]


def _low_points(batches):
    """Bridges and cut vertices by one depth-first walk without recursion."""
    from array import array

    import numpy as np
    import pandas as pd

    if (pdf := _whole(batches)) is None:
        return
    ids, start, to, row = _arcs(pdf)
    n, clock, bridges = len(ids), 0, []
    order, low, parent, via = (array("q", [x]) * n for x in (0, 0, -1, -1))
    at, cuts = start[:-1], bytearray(n)
    for root in range(n):
        if order[root]:
            continue
        order[root] = low[root] = clock = clock + 1
        x, kids = root, 0
        while True:
            if (k := at[x]) < start[x + 1]:
                at[x] = k + 1
                y = to[k]
                if row[k] == via[x]:
                    continue
                if order[y]:
                    low[x] = min(low[x], order[y])
                else:
                    order[y] = low[y] = clock = clock + 1
                    via[y], parent[y], x = row[k], x, y
            elif (p := parent[x]) >= 0:
                low[p] = min(low[p], low[x])
                if low[x] > order[p]:
                    bridges.append(via[x])
                if p == root:
                    kids += 1
                elif low[x] >= order[p]:
                    cuts[p] = 1
                x = p
            else:
                break
        if kids > 1:
            cuts[root] = 1
    found = pdf.iloc[bridges]
    found = found[~found["twice"]]
    at = ids[np.frombuffer(cuts, "bool")]
    yield pd.DataFrame({"src": found["u"], "dst": found["v"], "kind": "bridge"})
    yield pd.DataFrame({"src": at, "dst": at, "kind": "cut"})


def weak_points(edges: DataFrame) -> DataFrame:
    """Bridges (src < dst) and cut vertices (src = dst) of an undirected graph, told apart by ``kind``. Loops are nothing, a repeated edge is no bridge.

    Tasks reduce their edges to two forests each, in rounds over ever fewer shares; one task walks what is left, which is two
    edges a vertex at most. Any number of edges will do, but the vertices must fit that task.
    """
    e = edges.select(F.least("src", "dst").cast("long").alias("u"), F.greatest("src", "dst").cast("long").alias("v"), F.isnull("src").alias("_a"), F.isnull("dst").alias("_b")).where("not _a and not _b and u != v")
    e = cut(e.groupBy("u", "v").agg((F.count("*") > 1).alias("twice")))
    shares = -(-e.count() // SHARE)
    while shares > 1:
        e = cut(e.repartitionByRange(shares, "u", "v").mapInPandas(_two_forests, "u long, v long, twice boolean"))
        shares = -(-shares // 8)
    return e.repartition(1).mapInPandas(_low_points, "src long, dst long, kind string")


def bridges(edges: DataFrame) -> DataFrame:
    return weak_points(edges).where("kind = 'bridge'").select("src", "dst")


def cut_vertices(edges: DataFrame) -> DataFrame:
    return weak_points(edges).where("kind = 'cut'").select(F.col("src").alias("id"))


def max_flow_of(rows, source, sink) -> float:
    """Augmenting along shortest paths."""
    from collections import deque

    room: dict = {}
    for a, b, w in rows:
        room.setdefault(a, {})[b] = room.get(a, {}).get(b, 0) + w
        room.setdefault(b, {}).setdefault(a, 0)
    total = 0.0
    while True:
        parent, queue = {source: None}, deque([source])
        while queue and sink not in parent:
            v = queue.popleft()
            for u in sorted(room.get(v, {})):
                if u not in parent and room[v][u] > 1e-12:
                    parent[u] = v
                    queue.append(u)
        if sink not in parent:
            return total
        path, v = [], sink
        while parent[v] is not None:
            path.append((parent[v], v))
            v = parent[v]
        f = min(room[a][b] for a, b in path)
        for a, b in path:
            room[a][b] -= f
            room[b][a] += f
        total += f


def max_flow(edges: DataFrame, source: int, sink: int, most: int = 100_000) -> DataFrame:
    return _kernel(edges, lambda rows: [(max_flow_of(rows, source, sink),)], "flow double", most)


def matching_of(rows) -> list[tuple]:
    """A largest matching of left (src) to right (dst), in phases of disjoint shortest augmenting paths, without recursion."""
    near: dict = {}
    for a, b, _ in rows:
        near.setdefault(a, []).append(b)
    near = {a: sorted(set(bs)) for a, bs in near.items()}
    left, right = dict.fromkeys(near), {}
    while True:
        layer, depth, found = [a for a in near if left[a] is None], {}, False
        depth.update(dict.fromkeys(layer, 0))
        while layer and not found:
            after = []
            for a in layer:
                for b in near[a]:
                    if (owner := right.get(b)) is None:
                        found = True
                    elif owner not in depth:
                        depth[owner] = depth[a] + 1
                        after.append(owner)
            layer = after
        if not found:
            return sorted((a, b) for a, b in left.items() if b is not None)
        untried = {a: iter(bs) for a, bs in near.items()}
        for root in [a for a in near if left[a] is None]:
            path, taken = [root], []
            while path:
                a = path[-1]
                b = next(untried[a], None)
                if b is None:
                    path.pop()
                    if taken:
                        taken.pop()
                elif (owner := right.get(b)) is None:
                    for x, y in zip(path, [*taken, b]):
                        left[x], right[y] = y, x
                    break
                elif depth.get(owner) == depth[a] + 1:
                    path.append(owner)
                    taken.append(b)


def bipartite_matching(edges: DataFrame, most: int = 100_000) -> DataFrame:
    return _kernel(edges, matching_of, "src long, dst long", most)


def assignment_of(cost) -> tuple[float, list[int]]:
    """Cheapest assignment of rows to columns (potentials and shortest augmenting paths)."""
    n, m, inf = len(cost), len(cost[0]), float("inf")
    u, v, p, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        p[0], j0 = i, 0
        least, used = [inf] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = p[j0], inf, 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[p[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if p[j0] == 0:
                break
        while j0:
            p[j0] = p[way[j0]]
            j0 = way[j0]
    row = [0] * n
    for j in range(1, m + 1):
        if p[j]:
            row[p[j] - 1] = j - 1
    return sum(cost[i][row[i]] for i in range(n)), row


def depth_first_of(rows) -> tuple[list[tuple], bool]:
    """(vertex, parent, discovery, finish) of a walk over a directed graph, least vertices first, and whether it has a cycle."""
    near: dict = {}
    for a, b, _ in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set())
    found, done, clock, cycle = {}, {}, 0, False
    for root in sorted(near):
        if root in found:
            continue
        found[root], clock = (None, clock), clock + 1
        stack = [(root, iter(sorted(near[root])))]
        while stack:
            v, rest = stack[-1]
            for u in rest:
                if u not in found:
                    found[u], clock = (v, clock), clock + 1
                    stack.append((u, iter(sorted(near[u]))))
                    break
                cycle |= u not in done
            else:
                stack.pop()
                done[v], clock = clock, clock + 1
    return [(v, *found[v], done[v]) for v in sorted(found)], cycle


def depth_first(edges: DataFrame, most: int = 1_000_000) -> DataFrame:
    """id, parent, discovery and finish of every vertex of a directed graph of at most ``most`` edges, which is checked.

    The walk begins at the least vertex and takes the least neighbour first. An edge goes to a vertex that is not finished
    yet if and only if there is a cycle (see has_cycle).
    """
    run = lambda rows: [(v, float("nan") if p is None else float(p), d, f) for v, p, d, f in depth_first_of(rows)[0]]
    out = _kernel(edges, run, "id long, parent double, discovery long, finish long", most)
    return out.withColumn("parent", F.when(~F.isnan("parent"), F.col("parent")).cast("long"))


def has_cycle(edges: DataFrame) -> bool:
    """Whether a directed graph has a cycle: it has no topological layers then."""
    try:
        topological_layers(edges)
    except ValueError:
        return True
    return False


def a_star_of(rows, start, goal, estimate) -> tuple[float, list] | None:
    """Length and vertices of a shortest path, looking first where length so far and ``estimate`` (never too high) are least."""
    import heapq

    near: dict = {}
    for a, b, w in rows:
        near.setdefault(a, []).append((b, w))
    best, heap = {start: (0.0, None)}, [(estimate(start), start)]
    closed: set = set()
    while heap:
        _, v = heapq.heappop(heap)
        if v == goal:
            path = [v]
            while best[path[-1]][1] is not None:
                path.append(best[path[-1]][1])
            return best[goal][0], path[::-1]
        if v in closed:
            continue
        closed.add(v)
        for u, w in near.get(v, ()):
            length = best[v][0] + w
            if u not in best or length < best[u][0]:
                best[u] = (length, v)
                closed.discard(u)
                heapq.heappush(heap, (length + estimate(u), u))
    return None


def exact_colours(edges: DataFrame, most: int = 200) -> DataFrame:
    """id and colour with the fewest colours, for graphs of at most ``most`` edges, which is checked."""
    from millrace.functions.kernels_more import least_colours

    def run(rows):
        ids = sorted({v for a, b, _ in rows for v in (a, b)})
        number = {v: k for k, v in enumerate(ids)}
        return list(zip(ids, least_colours(len(ids), [(number[a], number[b]) for a, b, _ in rows if a != b])))

    return _kernel(edges, run, "id long, colour int", most)
