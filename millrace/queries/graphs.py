"""Queries of graph operators: nations as vertices, joined by who buys from whom."""

from pyspark.sql import functions as F

from millrace.operators import graph as g
from millrace.queries import Registry
from millrace.queries.statistics import rounded

R = Registry()

#: Customers' and suppliers' nations of all orders, as a directed graph with the least price as weight.
EDGES = "(SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, min(l_extendedprice) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey != s_nationkey GROUP BY 1, 2)"


def _edges(t):
    l = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return l.where("c_nationkey != s_nationkey").groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.min("l_extendedprice").alias("w"))


@R.add("graph_degrees", f"WITH e AS {EDGES} SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src id, 1 o, 0 i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY 1")
def _(t):
    return g.degrees(_edges(t))


@R.add("graph_transpose", f"WITH e AS {EDGES} SELECT dst AS src, src AS dst, w FROM e")
def _(t):
    return g.transpose(_edges(t)).select("src", "dst", "w")


BFS = f"WITH RECURSIVE e AS {EDGES}, s AS (SELECT min(src) s FROM e), b(id, distance) AS (SELECT s, 0::BIGINT FROM s UNION SELECT dst, distance + 1 FROM b JOIN e ON src = id WHERE distance < 30), m AS (SELECT id, min(distance) AS distance FROM b GROUP BY 1)"


@R.add("bfs_levels", BFS + " SELECT m.id, m.distance, (SELECT min(src) FROM e JOIN m p ON p.id = e.src WHERE e.dst = m.id AND p.distance = m.distance - 1) AS parent FROM m")
def _(t):
    e = _edges(t)
    return g.bfs(e, e.agg(F.min("src")).first()[0])


@R.add("sssp", f"WITH RECURSIVE e AS {EDGES}, s AS (SELECT min(src) s FROM e), d(id, distance, n) AS (SELECT s, 0.0::DOUBLE, 0 FROM s UNION SELECT id, min(distance), n FROM (SELECT dst AS id, distance + w AS distance, n + 1 AS n FROM d JOIN e ON src = id WHERE n < 24) GROUP BY id, n) SELECT id, round(min(distance), 4) AS distance FROM d GROUP BY 1")
def _(t):
    e = _edges(t)
    return rounded(g.shortest_paths(e, e.agg(F.min("src")).first()[0]).select("id", "distance"), distance=4)


#: Each part points to the one that is its size below, or to itself if there is none: every path ends at its component's least key.
@R.add("connected_components", "WITH RECURSIVE e AS (SELECT p.p_partkey a, coalesce(q.p_partkey, p.p_partkey) b FROM part p LEFT JOIN part q ON q.p_partkey = p.p_partkey - p.p_size), w(v, c) AS (SELECT a, b FROM e UNION ALL SELECT w.v, e.b FROM w JOIN e ON e.a = w.c WHERE e.a != e.b) SELECT v AS vertex, min(c) AS component FROM w GROUP BY 1")
def _(t):
    q = t.part.select(F.col("p_partkey").alias("below"))
    p = t.part.join(q, F.col("below") == F.col("p_partkey") - F.col("p_size"), "left")
    return g.components(p.select(F.col("p_partkey").alias("src"), F.coalesce("below", "p_partkey").alias("dst")))


@R.add("mst_weight", f"WITH RECURSIVE e AS {EDGES}, u AS (SELECT least(src, dst) a, greatest(src, dst) b, min(w) w FROM e GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (ORDER BY w, a, b) r FROM u), f(r, x, y, minw) AS (SELECT r, a, b, r FROM k) SELECT count(*) AS edges, round(sum(w), 2) AS weight FROM k WHERE NOT EXISTS (SELECT 1 FROM (WITH RECURSIVE p(v, start) AS (SELECT k.a, k.a UNION SELECT CASE WHEN q.a = p.v THEN q.b ELSE q.a END, p.start FROM p JOIN k q ON (q.a = p.v OR q.b = p.v) AND q.r < k.r) SELECT v FROM p) z WHERE z.v = k.b)")
def _(t):
    m = g.spanning_forest(_edges(t))
    return m.agg(F.count("*").alias("edges"), F.round(F.sum("w"), 2).alias("weight"))


@R.add("topo_layers", "WITH e AS (SELECT n_regionkey AS src, 100 + n_nationkey AS dst FROM nation) SELECT DISTINCT src::BIGINT AS id, 0 AS layer FROM e UNION ALL SELECT dst::BIGINT, 1 FROM e")
def _(t):
    return g.topological_layers(t.nation.select(F.col("n_regionkey").cast("long").alias("src"), (100 + F.col("n_nationkey")).cast("long").alias("dst")))


@R.add("scc", "WITH RECURSIVE e AS (SELECT p_partkey a, (p_partkey * 5 + 1) % 47 b FROM part), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), v AS (SELECT a AS id FROM e UNION SELECT b FROM e), m AS (SELECT x.a, min(x.b) AS b FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY x.a) SELECT id AS vertex, least(id, coalesce(m.b, id)) AS component FROM v LEFT JOIN m ON m.a = id")
def _(t):
    p = t.part
    return g.strong_components(p.select(F.col("p_partkey").alias("src"), ((F.col("p_partkey") * 5 + 1) % 47).alias("dst")))


@R.add("triangle_count", f"WITH e AS {EDGES}, u AS (SELECT DISTINCT least(src, dst) a, greatest(src, dst) b FROM e) SELECT count(*) AS n FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b")
def _(t):
    return g.triangles(_edges(t)).agg(F.count("*").alias("n"))


@R.add("all_pairs_paths", f"WITH RECURSIVE e AS {EDGES}, d(s, id, distance, n) AS (SELECT id, id, 0.0::DOUBLE, 0 FROM (SELECT src id FROM e UNION SELECT dst FROM e) UNION SELECT s, id, min(distance), n FROM (SELECT s, dst AS id, distance + w AS distance, n + 1 AS n FROM d JOIN e ON src = id WHERE n < 12) GROUP BY s, id, n) SELECT s AS src, id AS dst, round(min(distance), 4) AS distance FROM d GROUP BY 1, 2")
def _(t):
    return rounded(g.all_pairs(_edges(t)), distance=4)


@R.add("greedy_colouring")
def _(t):
    return g.greedy_colours(_edges(t))


#: Halving makes the parts one tree: every edge is a bridge, and every vertex with two edges or more a cut.
@R.add("bridges_and_cuts", "WITH e AS (SELECT p_partkey b, p_partkey // 2 a FROM part WHERE p_partkey > 0) SELECT a AS src, b AS dst, 'bridge' AS kind FROM e UNION ALL SELECT v, v, 'cut' FROM (SELECT a v FROM e UNION ALL SELECT b FROM e) GROUP BY v HAVING count(*) > 1")
def _(t):
    p = t.part.where("p_partkey > 0").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).alias("dst"))
    return g.weak_points(p)


@R.add("max_flow")
def _(t):
    e = _edges(t)
    lo, hi = e.agg(F.min("src"), F.max("dst")).first()
    return rounded(g.max_flow(e, lo, hi), flow=4)


@R.add("bipartite_matching")
def _(t):
    return g.bipartite_matching(_edges(t).select("src", (F.col("dst") + 1000).alias("dst"), "w"))


@R.add("page_rank")
def _(t):
    return rounded(g.page_rank(_edges(t)), rank=9)
