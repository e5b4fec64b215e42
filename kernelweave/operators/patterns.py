"""Pattern counts in graphs: homomorphisms by message passing and joins, cycles, graphlets, shortest paths.

``adj`` is (gid, u, v) with u < v; ``vertices`` (gid, vid), if given, names vertices that may have no edge.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import log_or_null
from .common import durable
from .convert import symmetric
from .walks import diagonals

#: Parents of the vertices of trees, root first: vertex k + 1 hangs on TREES[name][k].
TREES = {"edge": (0,), "path3": (0, 1), "star3": (0, 0, 0), "path4": (0, 1, 2), "fork5": (0, 0, 1, 1)}


# -- trees ---------------------------------------------------------------------------------------------


def children_of(parents: tuple[int, ...], root: int = 0) -> tuple:
    """The tree as nested sorted tuples of its subtrees, seen from a root."""
    near: dict[int, list[int]] = {k: [] for k in range(len(parents) + 1)}
    for k, parent in enumerate(parents, 1):
        near[k].append(parent)
        near[parent].append(k)

    def below(x: int, above: int) -> tuple:
        return tuple(sorted(below(y, x) for y in near[x] if y != above))

    return below(root, -1)


def height(tree: tuple) -> int:
    return 1 + max(map(height, tree)) if tree else 0


def flattest(parents: tuple[int, ...]) -> tuple:
    """The tree from the root that makes it lowest: the same for all trees that are alike."""
    return min((children_of(parents, r) for r in range(len(parents) + 1)), key=lambda t: (height(t), t))


@cache
def all_trees(most: int = 6) -> dict[str, tuple[int, ...]]:
    """Parents of every tree on 2..most vertices, one of each kind, by names such as t4_1."""
    out, level = {}, {(): ()}  # by the form from the flattest root
    for n in range(2, most + 1):
        level = {flattest(p): p for old in level.values() for p in ((*old, k) for k in range(n - 1))}
        out |= {f"t{n}_{k}": p for k, (_, p) in enumerate(sorted(level.items()), 1)}
    return out


def hom_trees(adj: DataFrame, trees: dict[str, tuple[int, ...]], vertices: DataFrame | None = None, by_graph: bool = True) -> DataFrame:
    """gid, pattern, hom of all trees at once: h_x(a) = product over children y of the sum of h_y over a's neighbours.

    Rooted subtrees that several trees share are counted once; a round sends what is known of a vertex to
    its neighbours, for all subtrees of one height more. One shuffle by graph serves all rounds, unless graphs are too large for that.
    """
    forms = {name: flattest(parents) for name, parents in trees.items()}
    known: set[tuple] = set()

    def collect(tree: tuple) -> None:
        for below in tree:
            collect(below)
        known.add(tree)

    for form in forms.values():
        collect(form)
    order = sorted(known, key=lambda t: (height(t), t))
    place = {t: k for k, t in enumerate(order)}
    rows = symmetric(adj).select("gid", F.col("u").alias("vid"), "v")
    if vertices is not None:
        rows = rows.unionByName(vertices.select("gid", "vid", F.lit(None).alias("v")))
    rows = rows.repartition("gid") if by_graph else rows
    state = rows.groupBy("gid", "vid").agg(F.collect_list("v").alias("near"))
    state = state.withColumn("h0", F.lit(1).cast("long"))
    done = [order[0]]
    for level in range(1, max(map(height, order)) + 1):
        columns = [f"h{place[t]}" for t in done]
        sends = F.transform("near", lambda n: F.struct(n.alias("to"), F.lit(False).alias("self")))
        each = state.withColumn("x", F.explode_outer(F.array_append(sends, F.struct(F.col("vid").alias("to"), F.lit(True).alias("self")))))
        kept = F.when(F.col("x.self"), F.struct("near", *columns))
        sent = [F.when(~F.col("x.self"), F.col(c)).alias(f"s{c}") for c in columns]
        met = each.select("gid", F.col("x.to").alias("vid"), kept.alias("own"), *sent).groupBy("gid", "vid")
        met = met.agg(F.first("own", ignorenulls=True).alias("own"), *[F.coalesce(F.sum(f"s{c}"), F.lit(0)).alias(f"s{c}") for c in columns])
        fresh = [t for t in order if height(t) == level]
        values = []
        for t in fresh:
            value = F.lit(1).cast("long")
            for below in t:
                value = value * F.col(f"sh{place[below]}")
            values.append(value.alias(f"h{place[t]}"))
        state = met.select("gid", "vid", "own.near", *[F.col(f"own.{c}") for c in columns], *values)
        done += fresh
    sums = state.groupBy("gid").agg(*[F.sum(f"h{place[form]}").alias(name) for name, form in forms.items()])
    pairs = F.array(*[F.struct(F.lit(name).alias("pattern"), F.col(name).alias("hom")) for name in forms])
    return sums.select("gid", F.explode(pairs).alias("x")).select("gid", "x.*")


def hom_tree(adj: DataFrame, parents: tuple[int, ...]) -> DataFrame:
    return hom_trees(adj, {"tree": parents}).select("gid", "hom")


def hom_path(adj: DataFrame, k: int) -> DataFrame:
    return hom_tree(adj, tuple(range(k - 1)))


def paths(most: int = 6) -> dict[str, tuple[int, ...]]:
    return {f"p{k}": tuple(range(k - 1)) for k in range(2, most + 1)}


def profile(adj: DataFrame, most: int = 6, vertices: DataFrame | None = None) -> DataFrame:
    """gid, homs: counts of all trees up to so many vertices, in the order of their names."""
    rows = hom_trees(adj, all_trees(most), vertices)
    return rows.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("pattern", "hom"))).alias("x")).select("gid", F.col("x.hom").alias("homs"))


def ghc_features(adj: DataFrame, types: str = "t", size: int = 6, vertices: DataFrame | None = None, by_graph: bool = True) -> DataFrame:
    """gid, pattern, x: logarithms of homomorphism counts of trees (t), paths (c, which the closing edge fails) or both.

    A graph without an edge has no homomorphism of any of them; its logarithm is null, not an infinity.
    """
    wanted = (all_trees(size) if "t" in types else {}) | (paths(size) if "c" in types else {})
    rows = hom_trees(adj, wanted, vertices, by_graph)
    return rows.select("gid", "pattern", log_or_null(F.col("hom")).alias("x"))


# -- patterns with cycles -------------------------------------------------------------------------------


def parts(n: int, edges: list[tuple[int, int]]) -> list[list[int]]:
    """Connected components of a pattern."""
    left, out = set(range(n)), []
    while left:
        work, found = [min(left)], set()
        while work:
            x = work.pop()
            if x not in found:
                found.add(x)
                work += [b if a == x else a for a, b in edges if x in (a, b)]
        out.append(sorted(found))
        left -= found
    return out


def _connected_hom(both: DataFrame, every: DataFrame, members: list[int], edges: list[tuple[int, int]], injective: bool) -> DataFrame:
    """gid, hom of one connected pattern: a join for each vertex, with sums as soon as a vertex is in no edge to come."""
    if len(members) == 1:
        return every.groupBy("gid").agg(F.count("*").alias("hom"))
    near = {x: {b if a == x else a for a, b in edges if x in (a, b)} for x in members}
    order = [max(members, key=lambda x: (len(near[x]), -x))]
    while len(order) < len(members):  # the vertex with the most edges to what is placed
        order.append(max((x for x in members if x not in order and near[x] & set(order)), key=lambda x: (len(near[x] & set(order)), -x)))
    first = order[0]
    table = both.select("gid", F.col("u").alias(f"x{first}")).distinct().withColumn("n", F.lit(1).cast("long"))
    bound = [first]
    for k, x in enumerate(order[1:], 1):
        hooks = sorted(near[x] & set(bound))
        arcs = both.select("gid", F.col("u").alias(f"x{hooks[0]}"), F.col("v").alias(f"x{x}"))
        table = table.join(arcs, ["gid", f"x{hooks[0]}"])
        for h in hooks[1:]:
            table = table.join(both.select("gid", F.col("u").alias(f"x{h}"), F.col("v").alias(f"x{x}")), ["gid", f"x{h}", f"x{x}"], "left_semi")
        if injective:
            for y in bound:
                table = table.where(F.col(f"x{x}") != F.col(f"x{y}"))
        bound.append(x)
        rest = order[k + 1 :]
        keep = bound if injective else [y for y in bound if near[y] & set(rest)]
        if rest and len(keep) < len(bound):
            table = table.groupBy("gid", *[f"x{y}" for y in keep]).agg(F.sum("n").alias("n"))
            bound = keep
    return table.groupBy("gid").agg(F.sum("n").alias("hom"))


def hom(adj: DataFrame, n: int, edges: list[tuple[int, int]], vertices: DataFrame | None = None, injective: bool = False, density: bool = False) -> DataFrame:
    """gid, hom: homomorphisms of any pattern on vertices 0..n-1; the product over its components.

    ``injective`` counts those that map vertices apart; ``density`` divides by (vertices of the graph) ** n.
    """
    both = durable(symmetric(adj))
    every = both.select("gid", F.col("u").alias("vid"))
    every = (every if vertices is None else every.unionByName(vertices.select("gid", "vid"))).distinct()
    sizes = every.groupBy("gid").agg(F.count("*").alias("size"))
    if injective and len(parts(n, edges)) > 1:
        raise ValueError("injective counts are of connected patterns")
    out, total = sizes, F.lit(1).cast("long")
    for k, members in enumerate(parts(n, edges)):
        own = [e for e in edges if e[0] in members]
        own_hom = _connected_hom(both, every, members, own, injective).withColumnRenamed("hom", f"c{k}")
        out = out.join(own_hom, "gid", "left")
        total = total * F.coalesce(f"c{k}", F.lit(0))
    value = total / F.pow(F.col("size"), F.lit(n)) if density else total
    return out.select("gid", value.alias("hom"))


def hom_cycle(adj: DataFrame, k: int) -> DataFrame:
    """trace(A^k)."""
    a = symmetric(adj).withColumn("w", F.lit(1).cast("long"))
    return diagonals(a, k).where(F.col("step") == k).groupBy("gid").agg(F.sum("p").alias("hom"))


def cycles(adj: DataFrame, k: int) -> DataFrame:
    """gid, cycles: simple cycles of k vertices. Each is found from its smallest vertex, in one of its two directions."""
    both = durable(symmetric(adj))
    walk = both.where("u < v").select("gid", F.col("u").alias("first"), F.array("u", "v").alias("path"), F.col("v").alias("last"))
    for _ in range(k - 2):
        step = both.select("gid", F.col("u").alias("last"), F.col("v").alias("next"))
        walk = walk.join(step, ["gid", "last"]).where((F.col("next") > F.col("first")) & ~F.array_contains("path", F.col("next")))
        walk = walk.select("gid", "first", F.array_append("path", F.col("next")).alias("path"), F.col("next").alias("last"))
    closes = both.select("gid", F.col("u").alias("last"), F.col("v").alias("first"))
    closed = walk.join(closes, ["gid", "last", "first"]).where(F.element_at("path", 2) < F.col("last"))
    return closed.groupBy("gid").agg(F.count("*").alias("cycles"))


def triangles(adj: DataFrame, by_graph: bool = True) -> DataFrame:
    """gid, triangles. Edges point to the end of the higher degree, so that hubs start few wedges.

    Degrees, directions, wedges and the edges that close them are groups by graph and something else, so one shuffle
    by graph serves all of them.
    """
    both = symmetric(adj)
    both = both.repartition("gid") if by_graph else both
    lists = both.groupBy("gid", "u").agg(F.collect_list("v").alias("near"))
    ends = lists.select("gid", "u", F.size("near").alias("d"), F.explode("near").alias("v"))
    a, b = F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")
    edges = ends.groupBy("gid", a, b).agg(F.max(F.when(F.col("u") < F.col("v"), F.col("d"))).alias("da"), F.max(F.when(F.col("u") > F.col("v"), F.col("d"))).alias("db"))
    up = F.col("da") <= F.col("db")
    arcs = edges.select("gid", F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("y"))
    outs = arcs.groupBy("gid", "x").agg(F.array_sort(F.collect_list("y")).alias("out"))
    each = outs.select("gid", "x", "out", F.posexplode("out").alias("at", "y"))
    own = F.struct(F.least("x", "y").alias("b"), F.greatest("x", "y").alias("c"), F.lit(0).alias("wedge"), F.lit(1).alias("edge"))
    rest = F.slice("out", F.col("at") + 2, F.greatest(F.size("out"), F.lit(1)))
    wedges = F.transform(rest, lambda z: F.struct(F.col("y").alias("b"), z.alias("c"), F.lit(1).alias("wedge"), F.lit(0).alias("edge")))
    rows = each.select("gid", F.explode_outer(F.concat(F.array(own), wedges)).alias("r")).select("gid", "r.*")
    met = rows.groupBy("gid", "b", "c").agg(F.sum("wedge").alias("n"), F.max("edge").alias("edge")).where("edge = 1 AND n > 0")
    return met.groupBy("gid").agg(F.sum("n").alias("triangles"))


# -- graphlets ------------------------------------------------------------------------------------------


def graphlets3(adj: DataFrame) -> DataFrame:
    """gid, triangles, paths: connected induced subgraphs on three vertices."""
    deg = symmetric(adj).groupBy("gid", "u").agg(F.count("*").alias("d"))
    wedges = deg.groupBy("gid").agg(F.sum((F.col("d") * (F.col("d") - 1) / 2).cast("long")).alias("wedges"))
    t = wedges.join(triangles(adj), "gid", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    return t.select("gid", "triangles", (F.col("wedges") - 3 * F.col("triangles")).alias("paths"))


@cache
def canonical_codes(k: int) -> tuple[int, ...]:
    """For each set of edges on k vertices, as bits over the pairs in order, the least one that is alike."""
    pairs = list(combinations(range(k), 2))
    place = {p: b for b, p in enumerate(pairs)}
    moves = [[place[tuple(sorted((perm[a], perm[b])))] for a, b in pairs] for perm in permutations(range(k))]
    best = list(range(1 << len(pairs)))
    for bits in range(len(best)):
        if best[bits] == bits:  # the least of its kind: all that it turns into are alike
            for move in moves:
                other = sum(1 << move[b] for b in range(len(pairs)) if bits >> b & 1)
                best[other] = min(best[other], bits)
    return tuple(best)


def connected_sets(adj: DataFrame, k: int) -> DataFrame:
    """gid, set: all sorted arrays of k vertices that are connected, each once, grown by one neighbour at a time."""
    both = durable(symmetric(adj))
    sets = adj.select("gid", F.array("u", "v").alias("set"))
    for _ in range(k - 2):
        each = sets.select("gid", "set", F.explode("set").alias("u")).join(both, ["gid", "u"])
        grown = each.where(~F.array_contains("set", F.col("v"))).select("gid", F.array_sort(F.array_append("set", F.col("v"))).alias("set"))
        sets = durable(grown.distinct())
    return sets


def coded(adj: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """The rows of (gid, set, ..) with ``code``: size and kind of the induced subgraph of each set."""
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.size("set") - 1), lambda i: F.transform(F.sequence(F.lit(0), F.size("set") - 1), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    each = sets.withColumn("p", F.explode(F.filter(pairs, lambda p: p["i"] <= p["j"])))
    each = each.select(*sets.columns, "p", F.element_at("set", F.col("p.i") + 1).alias("u"), F.element_at("set", F.col("p.j") + 1).alias("v"))
    here = adj.select("gid", "u", "v", F.lit(1).alias("edge"))
    each = each.join(here, ["gid", "u", "v"], "left")
    out = None
    for size in range(1, k + 1):
        bit = F.lit(0)
        for b, (i, j) in enumerate(combinations(range(size), 2)):
            bit = F.when((F.col("p.i") == i) & (F.col("p.j") == j), 1 << b).otherwise(bit)
        rows = each.where(F.size("set") == size).groupBy(*sets.columns).agg(F.sum(bit * F.coalesce("edge", F.lit(0))).alias("bits"))
        kinds = F.array(*map(F.lit, canonical_codes(size))) if size > 1 else F.array(F.lit(0))
        rows = rows.withColumn("code", F.concat_ws(":", F.lit(str(size)), F.element_at(kinds, (F.col("bits") + 1).cast("int")).cast("string"))).drop("bits")
        out = rows if out is None else out.unionByName(rows)
    return out


def graphlets(adj: DataFrame, k: int) -> DataFrame:
    """features(gid, fid, cnt): connected induced subgraphs on k vertices (k up to 5) by kind."""
    rows = coded(adj, connected_sets(adj, k), k)
    return rows.groupBy("gid", F.col("code").alias("fid")).agg(F.count("*").alias("cnt"))


#: The number of graphs on 1 to 9 vertices in the bound on samples.
KINDS = {1: 1, 2: 2, 3: 4, 4: 8, 5: 19, 6: 53, 7: 209, 8: 1253, 9: 13599}


def sample_size(k: int, delta: float = 0.05, epsilon: float = 0.05) -> int:
    from math import ceil, log10

    return ceil(2 * (KINDS[k] * log10(2) + log10(1 / delta)) / epsilon**2 / 200)


def sampled_graphlets(adj: DataFrame, vertices: DataFrame, k: int = 5, samples: int | None = None, seed: int = 2023) -> DataFrame:
    """features(gid, fid, cnt): induced subgraphs of uniform samples of min(vertices, k) vertices, connected or not.

    A sample takes the vertices with its smallest seeded hashes, so the result does not depend on partitions.
    """
    n = sample_size(k) if samples is None else samples
    every = vertices.select("gid", "vid").unionByName(symmetric(adj).select("gid", F.col("u").alias("vid")))
    lists = every.groupBy("gid").agg(F.collect_set("vid").alias("all"))
    draws = lists.select("gid", "all", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("draw"))
    ranked = F.array_sort(F.transform("all", lambda v: F.struct(F.xxhash64("gid", "draw", v, F.lit(seed)).alias("h"), v.alias("v"))))
    chosen = F.array_sort(F.transform(F.slice(ranked, 1, k), lambda x: x["v"]))
    rows = coded(adj, durable(draws.select("gid", "draw", chosen.alias("set"))), k)
    return rows.groupBy("gid", F.col("code").alias("fid")).agg(F.count("*").alias("cnt"))


# -- shortest paths -------------------------------------------------------------------------------------


def shortest_paths(adj: DataFrame, most: int | None = None) -> DataFrame:
    """gid, u, v, d for ordered pairs of distinct vertices that reach each other (within ``most`` steps, if given).

    In a round, the pairs that were new meet the neighbours of their ends, and a pair keeps its least distance; the
    rounds go on until none is new.
    """
    both = durable(symmetric(adj))
    kind = dict(both.dtypes)["u"]
    none, nobody = F.lit(None).cast(kind), F.lit(None).cast(f"array<{kind}>")
    near = durable(both.groupBy("gid", "u").agg(F.collect_list("v").alias("near")).select("gid", F.col("u").alias("m"), none.alias("src"), "near"))
    reached, d = both.select("gid", "u", "v", F.lit(1).alias("d")), 1
    while most is None or d < most:
        ends = reached.where(F.col("d") == d).select("gid", F.col("v").alias("m"), F.col("u").alias("src"), nobody.alias("near"))
        met = ends.unionByName(near).groupBy("gid", "m").agg(F.collect_list("src").alias("srcs"), F.first("near", ignorenulls=True).alias("near"))
        step = met.select("gid", "near", F.explode("srcs").alias("u")).select("gid", "u", F.explode("near").alias("v")).where("u != v")
        d += 1
        reached = durable(reached.unionByName(step.withColumn("d", F.lit(d))).groupBy("gid", "u", "v").agg(F.min("d").alias("d")))
        if reached.where(F.col("d") == d).isEmpty():
            break
    return reached


def path_histogram(adj: DataFrame, vertices: DataFrame | None = None, bins: int = 40) -> DataFrame:
    """gid, d, n: entries of the matrix of distances, all vertices by all, of each value.

    Distances end at ``bins`` - 1, which also stands for pairs that do not reach each other; a vertex with a neighbour is two
    steps from itself, one without as far as from any other.
    """
    far = bins - 1
    both = symmetric(adj)
    reached = shortest_paths(adj, far).select("gid", F.least("d", F.lit(far)).alias("d"))
    busy = both.select("gid", "u").distinct()
    every = busy.withColumnRenamed("u", "vid")
    every = every if vertices is None else every.unionByName(vertices.select("gid", "vid")).distinct()
    own = busy.select("gid", F.lit(min(2, far)).alias("d"))
    found = reached.unionByName(own).groupBy("gid", "d").agg(F.count("*").alias("n"))
    size = every.groupBy("gid").agg(F.count("*").alias("size"))
    held = found.groupBy("gid").agg(F.sum("n").alias("held"))
    missing = size.join(held, "gid", "left").select("gid", F.lit(far).alias("d"), (F.col("size") * F.col("size") - F.coalesce("held", F.lit(0))).alias("n"))
    return found.unionByName(missing.where("n > 0")).groupBy("gid", "d").agg(F.sum("n").alias("n"))


def binned(histogram: DataFrame, bins: int = 40) -> DataFrame:
    """gid, dim, x: counts of (gid, d, n) in equal bins between the graph's least and largest value; one value has a bin in the middle."""
    ends = histogram.groupBy("gid").agg(F.min("d").alias("low"), F.max("d").alias("high"))
    same = F.col("low") == F.col("high")
    low, high = F.when(same, F.col("low") - 1).otherwise(F.col("low")), F.when(same, F.col("high") + 1).otherwise(F.col("high"))
    place: Column = F.least(F.lit(bins - 1), F.floor((F.col("d") - low) * bins / (high - low)))
    rows = histogram.join(ends, "gid").select("gid", place.cast("int").alias("dim"), "n")
    return rows.groupBy("gid", "dim").agg(F.sum("n").cast("double").alias("x"))


def edge_histogram(adj: DataFrame) -> DataFrame:
    """gid, d, n: what relaxing only the stored entries leaves: every arc at distance 1."""
    return symmetric(adj).groupBy("gid").agg(F.count("*").alias("n")).select("gid", F.lit(1).alias("d"), "n")
