"""Kernels by name, with fit on training graphs and rows of kernel values for others.

A collection is :class:`Graphs`: incidence(gid, eid, vid), and vertices(gid, vid[, lbl]) if some are isolated or have labels
of their own. Where a kernel is of graphs, hyperedges become cliques.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import convert, kernels, patterns, persistence, refine, refine_ids, soft, spectral, walks
from ..operators.common import durable


@dataclass(frozen=True)
class Graphs:
    inc: DataFrame
    vertices: DataFrame | None = None
    #: Whether a graph is small enough for one task; else every step is dealt out anew.
    by_graph: bool = True

    @property
    def adj(self) -> DataFrame:
        return convert.clique(self.inc)

    @property
    def all_vertices(self) -> DataFrame:
        own = self.inc.select("gid", "vid")
        return (own if self.vertices is None else own.unionByName(self.vertices.select("gid", "vid"))).distinct()

    @property
    def ids(self) -> DataFrame:
        return self.all_vertices.select("gid").distinct()

    def star(self) -> DataFrame:
        return convert.star(self.inc)

    def where(self, ids: DataFrame) -> Graphs:
        """The graphs of ``ids`` (gid)."""
        keep = lambda df: df.join(ids.select("gid"), "gid", "left_semi")
        return Graphs(keep(self.inc), None if self.vertices is None else keep(self.vertices), self.by_graph)


def graphs(collection: Graphs | DataFrame) -> Graphs:
    return collection if isinstance(collection, Graphs) else Graphs(collection)


@dataclass
class Kernel:
    """``features`` maps graphs to features(gid, fid, cnt).

    Other graphs' own values are of the same kind as the kernel's; with ``compat`` they are sums of squares also where the
    kernel is of histogram intersections.
    """

    features: Callable[[Graphs], DataFrame]
    how: str = "product"
    normalise: bool = True
    train: DataFrame | None = None
    compat: bool = False

    def fit(self, collection: Graphs | DataFrame) -> Kernel:
        self.train = durable(self._totals(self.fitted_features(graphs(collection))))
        return self

    def fitted_features(self, g: Graphs) -> DataFrame:
        return self.features(g)

    def other_features(self, g: Graphs) -> DataFrame:
        return self.features(g)

    def fit_transform(self, collection: Graphs | DataFrame) -> DataFrame:
        return self.fit(collection)._kernel(self.train)

    def transform(self, collection: Graphs | DataFrame) -> DataFrame:
        """Against the training graphs; only labels that training has seen count."""
        rows = durable(self._totals(self.other_features(graphs(collection))))
        return self._kernel(refine.seen_only(rows, self.train), "product" if self.compat else self.how)

    @staticmethod
    def _totals(features: DataFrame) -> DataFrame:
        return features.groupBy("gid", "fid").agg(F.sum("cnt").alias("cnt"))

    def _kernel(self, rows: DataFrame, own: str | None = None) -> DataFrame:
        k = kernels.gram(rows, self.train, self.how)
        if not self.normalise:
            return k
        return kernels.normalised(k, kernels.self_products(rows, own or self.how), kernels.self_products(self.train, self.how))


@dataclass
class FittedKernel(Kernel):
    """``features`` maps graphs and what a fit has learned to features and what it learns."""

    learned: refine_ids.Dictionary | None = None

    def fitted_features(self, g: Graphs) -> DataFrame:
        out, self.learned = self.features(g, None)
        return out

    def other_features(self, g: Graphs) -> DataFrame:
        return self.features(g, self.learned)[0]


@dataclass
class VectorKernel:
    """exp(-distance / median) of vectors(gid, dim, x), each matrix by its own median."""

    vectors: Callable[[Graphs], DataFrame]
    p: int = 2
    extra: float = 0.0
    train: DataFrame | None = None
    ids: DataFrame | None = None

    def fit(self, collection: Graphs | DataFrame) -> VectorKernel:
        self.train, self.ids = self._of(collection)
        return self

    def _of(self, collection: Graphs | DataFrame) -> tuple[DataFrame, DataFrame]:
        g = graphs(collection)
        return durable(self.vectors(g).where("x IS NOT NULL")), durable(g.ids)

    def fit_transform(self, collection: Graphs | DataFrame) -> DataFrame:
        self.fit(collection)
        return self._kernel(self.train, self.ids)

    def transform(self, collection: Graphs | DataFrame) -> DataFrame:
        return self._kernel(*self._of(collection))

    def _kernel(self, rows: DataFrame, ids: DataFrame) -> DataFrame:
        d = durable(kernels.distances(rows, self.p, self.train, ids, self.ids))
        return kernels.exponential(d, self.extra)


@dataclass
class SumKernel:
    """The sum of several kernels."""

    parts: list = field(default_factory=list)

    def fit(self, collection: Graphs | DataFrame) -> SumKernel:
        for part in self.parts:
            part.fit(collection)
        return self

    def fit_transform(self, collection: Graphs | DataFrame) -> DataFrame:
        return kernels.summed(*[part.fit_transform(collection) for part in self.parts])

    def transform(self, collection: Graphs | DataFrame) -> DataFrame:
        return kernels.summed(*[part.transform(collection) for part in self.parts])


@dataclass
class PersistenceKernel:
    """Label counts of two rounds plus exp(-distance / median) of persistence and cycle weights by label."""

    p: float = 1
    normalise: bool = False
    counts: Kernel | None = None
    vectors: VectorKernel | None = None

    def fit(self, collection: Graphs | DataFrame) -> PersistenceKernel:
        self.counts = Kernel(lambda g: refine.graph_wl(g.adj, 2, g.vertices, g.by_graph), normalise=self.normalise)
        self.vectors = VectorKernel(lambda g: persistence.persistence_features(g.adj, self.p, g.vertices)[0])
        self.counts.fit(collection), self.vectors.fit(collection)
        return self

    def fit_transform(self, collection: Graphs | DataFrame) -> DataFrame:
        self.fit(collection)
        return kernels.summed(self.counts._kernel(self.counts.train), self.vectors._kernel(self.vectors.train, self.vectors.ids))

    def transform(self, collection: Graphs | DataFrame) -> DataFrame:
        """Labels that training has not seen have no dimension."""
        rows, ids = self.vectors._of(collection)
        known = self.vectors.train.select(F.substring_index("dim", ":", -1).alias("fid")).unionByName(self.counts.train.select("fid")).distinct()
        rows = rows.withColumn("fid", F.substring_index("dim", ":", -1)).join(known, "fid", "left_semi").drop("fid")
        return kernels.summed(self.counts.transform(collection), self.vectors._kernel(rows, ids))


def fourier(steps: int, returns: Callable[[Graphs], DataFrame], dimensions: int = 4000) -> VectorKernel:
    """Mean Fourier features of vertices' return probabilities."""

    def vectors(g: Graphs) -> DataFrame:
        return spectral.fourier_means(walks.rows_of(returns(g), steps), dimensions)

    return VectorKernel(vectors, extra=1e-5)


def degree_steps(g: Graphs, steps: int) -> DataFrame:
    """gid, vid, step, p: the degree walk is the same at every step."""
    every = F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step")
    return walks.degree_walk(g.inc).select("gid", "vid", every, "p")


def homs(types: str, adj: Callable[[Graphs], DataFrame]) -> VectorKernel:
    def vectors(g: Graphs) -> DataFrame:
        return patterns.ghc_features(adj(g), types, by_graph=g.by_graph).withColumnRenamed("pattern", "dim")

    return VectorKernel(vectors, p=1)


def motifs(table: Callable[[], DataFrame] | DataFrame) -> Kernel:
    """A kernel on precomputed vectors (gid, x array<double>), of which the graphs' own rows are taken."""

    def features(g: Graphs) -> DataFrame:
        rows = table() if callable(table) else table
        each = rows.join(g.ids, "gid", "left_semi").select("gid", F.posexplode("x").alias("fid", "cnt"))
        return each.select("gid", F.col("fid").cast("string").alias("fid"), "cnt").where("cnt != 0")

    return Kernel(features)


def wl(rounds: int, how: str = "product") -> Kernel:
    return Kernel(lambda g: refine.hypergraph_wl(g.inc, rounds, g.vertices, g.by_graph), how=how)


def walk_kernel(steps: int) -> VectorKernel:
    return fourier(steps, lambda g: walks.return_probabilities(walks.hypergraph_walk(g.inc), steps))


KERNELS: dict[str, Callable[..., object]] = {
    "graph_subtree": lambda: Kernel(lambda g: refine.graph_wl(g.adj, 4, g.vertices, g.by_graph)),
    "graphlet_sampling": lambda: Kernel(lambda g: patterns.sampled_graphlets(g.adj, g.all_vertices)),
    "graph_retgk": lambda: fourier(3, lambda g: walks.return_probabilities(walks.graph_walk(g.adj, g.vertices), 3)),
    "hypergraph_rethgk": lambda: walk_kernel(3),
    "graph_shortestpath": lambda: VectorKernel(lambda g: patterns.binned(patterns.path_histogram(g.adj, g.vertices))),
    "hypergraph_rooted": lambda: Kernel(lambda g: soft.fused(soft.rooted_sampled(g.inc))),
    "hypergraph_directed_line": lambda: Kernel(lambda g: refine_ids.directed_line_wl(g.inc, 4, g.by_graph)),
    "hypergraph_subtree": lambda: wl(4, "least"),
    "hypergraph_hyedge": lambda: Kernel(lambda g: refine.hyperedge_wl(g.inc, 4, g.vertices, g.by_graph)),
    "hypergraph_ewl": lambda: FittedKernel(lambda g, known: refine_ids.early_stopping_wl(g.inc, 2, 2, g.vertices, known)),
    "hypergraph_sum_wl": lambda: FittedKernel(lambda g, known: refine_ids.sum_wl(g.inc, 2, g.vertices, known)),
    "graph_2wl": lambda: Kernel(lambda g: refine_ids.two_wl(g.adj, 2, g.vertices)),
    "graph_persistencewl": lambda: PersistenceKernel(),
    "graph_homo": lambda: homs("t", lambda g: g.adj),
    "hypergraph_svk": lambda: SumKernel([wl(2), fourier(5, lambda g: degree_steps(g, 5))]),
    "hypergraph_sck": lambda: SumKernel([wl(2), homs("c", lambda g: g.star())]),
    "hypergraph_spk": lambda: SumKernel([wl(2), walk_kernel(5)]),
    "hypergraph_motifs": motifs,
    "hypergraph_mochy": motifs,
    "hypergraph_soft": lambda: fourier(4, lambda g: walks.return_probabilities(soft.soft_walk(g.inc, g.vertices if g.vertices is not None and "lbl" in g.vertices.columns else None), 4)),
    "hypergraph_hsvd": lambda: VectorKernel(lambda g: spectral.fourier_means(spectral.singular_vectors(g.inc, 20), 4000), extra=1e-5),
    "hypergraph_v_e": lambda: wl(0),
    "hypergraph_ve": lambda: wl(0),
    "hypergraph_oa": lambda: wl(4, "least"),
}
