"""Queries over the test tables by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import convert, generators, kernels, learn, patterns, persistence, refine, refine_ids, soft, spectral, structure, svm, walks
from ..sources.collections import orders_by, read, sessions
from .oracles import ORACLES
from .registry import KERNELS, Graphs, motifs

__all__ = ["ORACLES", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


def on_incidence(gid: str, vid: str, plan: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: plan(orders_by(spark, sf_dir, gid, vid))


def on_customers(plan):
    return on_incidence("customer", "p_brand", plan)


def on_whole_customers(plan, vid: str = "p_brand"):
    """For operators of whole graphs, to which repeated members make no difference: one shuffle less."""
    return lambda spark, sf_dir: plan(orders_by(spark, sf_dir, "customer", vid, distinct=False))


def on_nations(plan):
    return on_incidence("nation", "p_brand", plan)


def on_cliques(plan):
    return on_incidence("customer", "p_type", lambda inc: plan(convert.clique(inc)))


def totals(features: DataFrame) -> DataFrame:
    return features.groupBy("gid", "fid").agg(F.sum("cnt").alias("cnt"))


def normalised(features: DataFrame) -> DataFrame:
    own = kernels.self_products(features)
    return kernels.normalised(kernels.gram(features), own, own)


def transform_unseen(inc: DataFrame) -> DataFrame:
    features = refine.hypergraph_wl(inc, 2, by_graph=False)
    return refine.seen_only(features.where("gid % 5 = 0"), features.where("gid % 5 != 0")).select("gid", "fid", "cnt")


def rounded_p(rows: DataFrame) -> DataFrame:
    """Six decimals; sums of halves that end in a 5 go up, in whichever order they were added."""
    return rows.withColumn("p", F.round(F.col("p") + 1e-12, 6))


def with_brands(plan: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    """Customers' hypergraphs with all brands as vertices, most of them isolated, labelled with their makers."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        inc = orders_by(spark, sf_dir, "customer", "p_brand")
        brands = read(spark, sf_dir, "part").select(F.col("p_brand").alias("vid")).distinct()
        vertices = inc.select("gid").distinct().crossJoin(F.broadcast(brands))  # 25 brands
        return plan(inc, vertices.withColumn("lbl", F.substring("vid", 1, 7)))

    return query


def logs(adj: DataFrame, types: str = "t") -> DataFrame:
    return patterns.ghc_features(adj, types).withColumn("x", F.round("x", 9))


def kernel_sum(inc: DataFrame) -> DataFrame:
    features = refine.hypergraph_wl(inc, 1, by_graph=False)
    return kernels.summed(kernels.gram(features), kernels.gram(features, how="least"))


def class_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return rows.groupBy(F.col("label").cast("long").alias("gid"), "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))


def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth vector by the three nearest of the others, by Euclidean distance."""
    rows = vectors(spark, sf_dir).select("gid", "x")
    found = learn.nearest(rows.where("gid % 5 != 0"), rows.where("gid % 5 = 0"), 3)
    return learn.knn(found, read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("gid"), F.col("label").alias("y")))


def labelled_clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, sf_dir, "embeddings")
    long = rows.select(F.col("vec_id").alias("gid"), F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return long, rows.select(F.col("vec_id").alias("gid"), F.col("label").alias("cluster"))


def knn_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("gid"), F.col("label").alias("y"))
    return knn(spark, sf_dir).join(truth, "gid")


def multi_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot = lambda c, v, name: (F.col(c) == v).cast("int").alias(name)
    return read(spark, sf_dir, "labels").select("doc_id", hot("quality", 0, "c0"), hot("quality", 1, "c1"), hot("toxic", 1, "c2"))


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.kfold(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("gid")).distinct(), 5)


def fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("quality").cast("double")
    rows = read(spark, sf_dir, "labels").groupBy((F.col("doc_id") % 5).alias("fold"))
    return rows.agg(F.round(F.avg(q), 9).alias("mean"), F.round(F.var_pop(q), 9).alias("var"))


def distance(p: int) -> Query:
    return lambda spark, sf_dir: kernels.distances(class_means(spark, sf_dir), p).withColumn("d", F.round("d", 5))


def homs(name: str) -> Query:
    return on_cliques(lambda adj: patterns.hom_tree(adj, patterns.TREES[name]))


def rounded_k(kernel: DataFrame, places: int = 6) -> DataFrame:
    return kernel.withColumn("k", F.round(F.col("k").cast("double"), places))


def named(name: str, vid: str = "p_brand", places: int = 9) -> Query:
    """The kernel of that name among nations, which are few and large."""
    return on_incidence("nation", vid, lambda inc: rounded_k(KERNELS[name]().fit_transform(Graphs(inc, by_graph=False)), places))


def motif_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by the embeddings with their numbers, which stand for precomputed features."""
    rows = vectors(spark, sf_dir).select("gid", "x")
    return rounded_k(motifs(rows).fit_transform(orders_by(spark, sf_dir, "nation", "p_brand")))


def svm_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of nations from their hypergraphs, in five folds."""
    inc = orders_by(spark, sf_dir, "nation", "p_brand")
    kernel = normalised(refine.hypergraph_wl(inc, 2, by_graph=False))
    labels = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("gid"), F.col("n_regionkey").cast("string").alias("y"))
    return svm.predict(kernel, labels, learn.kfold(inc.select("gid").distinct(), 5))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("gid"), x.alias("x"), F.col("label").cast("double").alias("y"))


def learned(name: str, classes: int = 10) -> Query:
    def query(spark, sf_dir):
        rows = vectors(spark, sf_dir).withColumn("y", F.col("y") % classes)
        return svm.learner_predictions(rows.where("gid % 5 != 0"), rows.where("gid % 5 = 0"), name)

    return query


def label_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What always guessing good and harmless would give."""
    truth = F.array(F.col("quality").cast("int"), F.col("toxic").cast("int"))
    return learn.multilabel_metrics(read(spark, sf_dir, "labels").select(truth.alias("truth"), F.array(F.lit(1), F.lit(0)).alias("pred")))


QUERIES: dict[str, Query] = {
    "hg_incidence": on_customers(lambda inc: inc),
    "hg_degree_v": on_customers(convert.degree_v),
    "hg_degree_e": on_customers(convert.degree_e),
    "label_dense_rank": on_customers(lambda inc: convert.dense_labels(convert.degree_v(inc), "deg")),
    "multi_hot_labels": multi_hot,
    "clique_expand": on_customers(convert.clique),
    "graph_to_hypergraph": on_customers(lambda inc: convert.as_hypergraph(convert.clique(inc))),
    "star_expand": on_customers(convert.star),
    "hyperedge_overlap": on_customers(convert.overlaps),
    "vertex_cooccurrence": on_customers(convert.cooccurrence),
    "line_expand": on_customers(lambda inc: convert.directed_line(inc)[1].groupBy("gid").agg(F.count("*").alias("arcs"))),
    "hg_label_histogram": on_customers(lambda inc: totals(refine.hypergraph_wl(inc, 0))),
    "wl_features_r2": on_customers(lambda inc: totals(refine.hypergraph_wl(inc, 2))),
    "wl_gram": on_nations(lambda inc: kernels.gram(refine.hypergraph_wl(inc, 2, by_graph=False))),
    "wl_gram_oa": on_nations(lambda inc: kernels.gram(refine.hypergraph_wl(inc, 2, by_graph=False), how="least")),
    "wl_kernel_norm": on_nations(lambda inc: normalised(refine.hypergraph_wl(inc, 2, by_graph=False))),
    "wl_transform_unseen": on_nations(transform_unseen),
    "hyedge_features": on_customers(lambda inc: totals(refine.hyperedge_wl(inc, 2))),
    "hyedge_kernel": on_nations(lambda inc: normalised(refine.hyperedge_wl(inc, 2, by_graph=False))),
    "list_wl_features": on_customers(lambda inc: totals(refine.list_wl(inc, 2))),
    "graph_wl_features": on_cliques(lambda adj: totals(refine.graph_wl(adj, 2))),
    "sum_wl_features": on_customers(lambda inc: totals(refine_ids.sum_wl(inc, 2)[0])),
    "ewl_features": on_whole_customers(lambda inc: refine_ids.early_stopping_whole(inc, 3, 3)),
    "two_wl_features": on_whole_customers(lambda inc: refine_ids.two_wl_cliques(inc, 2), "p_type"),
    "directed_line_features": on_customers(lambda inc: totals(refine_ids.directed_line_wl(inc, 2))),
    "soft_edge_weights": on_customers(soft.soft_edge_weights),
    "rooted_expected_sequences": on_whole_customers(lambda inc: rounded_p(soft.rooted_expected_whole(inc))),
    "evmn_features": on_customers(lambda inc: walks.degree_walk(inc).withColumn("p", F.round("p", 9))),
    "return_prob_hyper": on_nations(lambda inc: rounded_p(walks.diagonals(walks.hypergraph_walk(inc), 3))),
    "return_prob_graph": on_cliques(lambda adj: rounded_p(walks.diagonals(walks.graph_walk(adj), 3))),
    "isomo_trace_features": on_whole_customers(lambda inc: walks.cooccurrence_traces(inc, 3, by_graph=True)),
    "hom_edge": homs("edge"),
    "hom_path3": homs("path3"),
    "hom_star3": homs("star3"),
    "hom_path4": homs("path4"),
    "hom_fork5": homs("fork5"),
    "hom_cycle3": on_cliques(lambda adj: patterns.hom_cycle(adj, 3)),
    "triangle_count": on_cliques(patterns.triangles),
    "graphlet3_counts": on_cliques(patterns.graphlets3),
    "shortest_path_hist": on_cliques(patterns.path_histogram),
    "ghc_features": on_cliques(logs),
    "pairwise_l1": distance(1),
    "pairwise_l2": distance(2),
    "exp_median_kernel": lambda spark, sf_dir: kernels.exponential(kernels.distances(class_means(spark, sf_dir), 2), 1e-5).withColumn("k", F.round("k", 5)),
    "kernel_sum": on_nations(kernel_sum),
    "knn3_predict": knn,
    "acc_f1_metrics": lambda spark, sf_dir: learn.classification_metrics(knn_scored(spark, sf_dir)),
    "hamming_loss": lambda spark, sf_dir: learn.hamming_loss(read(spark, sf_dir, "labels").selectExpr("quality AS a", "toxic AS b")),
    "adjusted_rand": lambda spark, sf_dir: learn.adjusted_rand(knn_scored(spark, sf_dir).selectExpr("y AS a", "pred AS b")),
    "kfold_assign": folds,
    "cv_mean_var": fold_scores,
    "ghc_kernel": named("graph_homo", places=6),
    "multilabel_metrics": label_sets,
    "normalized_mutual_info": lambda spark, sf_dir: learn.normalized_mutual_info(knn_scored(spark, sf_dir).selectExpr("y AS a", "pred AS b")),
    "hsvd_kernel": named("hypergraph_hsvd"),
    "svm_predict": svm_predict,
    "logreg_predict": learned("logreg"),
    "nb_predict": learned("bayes"),
    "rf_predict": learned("forest"),
    "gbt_predict": learned("boosting", 2),
    "ada_predict": learned("stumps"),
    "kmeans_assign": lambda spark, sf_dir: svm.clusters(vectors(spark, sf_dir), 10),
    "gen_flower": lambda spark, _: generators.flower(spark, 20, 4, 3),
    "gen_cycle": lambda spark, _: generators.cycle(spark, 20, 2, 3),
    "gen_wheel": lambda spark, _: generators.wheel(spark, 20, 3, 2, 3),
    "gen_fern": lambda spark, _: generators.fern(spark, 5, 3),
    "gen_random_linked": lambda spark, _: generators.composite(spark, 5)[0],
    "gen_uniform": lambda spark, _: generators.uniform(spark, 20, 50, 100, 4),
    "gen_chain": lambda spark, _: generators.chain(spark, 20, 2, 3),
    "gen_lattice": lambda spark, _: generators.lattice(spark, 9),
}
QUERIES |= {
    "wl_features_given": with_brands(lambda inc, v: totals(refine.hypergraph_wl(inc, 2, v))),
    "average_degree": with_brands(convert.average_degree),
    "isolated_degrees": with_brands(convert.degrees),
    "distinct_label_counts": on_customers(lambda inc: structure.distinct_labels(convert.degree_v(inc), "deg", "vid")),
    "one_hot_features": on_customers(lambda inc: structure.one_hot(convert.dense_labels(convert.degree_v(inc), "deg"))),
    "graph_components": on_cliques(structure.components),
    "tree_test": on_cliques(structure.is_tree),
    "induced_edges": on_cliques(lambda adj: structure.induced(adj, convert.symmetric(adj).select("gid", F.col("u").alias("vid")).where("vid LIKE '%A%'"))),
    "symmetric_walk": on_nations(lambda inc: rounded_p(walks.diagonals(walks.symmetric_walk(inc), 2))),
    "lazy_walk": on_cliques(lambda adj: walks.lazy_walk(adj, 0.3).withColumn("w", F.when(F.col("u") == F.col("v"), F.col("w")).otherwise(F.round(F.col("w") + 1e-12, 9)))),
    "soft_walk": on_whole_customers(lambda inc: soft.soft_returns(inc, 2).withColumn("p", F.round(F.col("p") + 1e-12, 5))),
    "rooted_kernel_fuse": on_nations(lambda inc: kernels.gram(soft.fused(soft.rooted_features(inc))).withColumn("k", F.round(F.col("k") + 1e-12, 5))),
    "rooted_sampled": on_customers(soft.rooted_sampled),
    "automatic_walks": on_customers(soft.automatic_walks),
    "hom_tree_profile": on_cliques(lambda adj: patterns.hom_trees(adj, patterns.all_trees())),
    "ghc_paths": on_cliques(lambda adj: logs(adj, "c")),
    "hom_diamond": on_cliques(lambda adj: patterns.hom(adj, 4, [(0, 1), (1, 2), (2, 3), (0, 3), (0, 2)]).where("hom > 0")),
    "injective_path_count": on_cliques(lambda adj: patterns.hom(adj, 4, [(0, 1), (1, 2), (2, 3)], injective=True).where("hom > 0")),
    "k_cycle_count": on_cliques(lambda adj: patterns.cycles(adj, 4)),
    "graphlet4_counts": on_cliques(lambda adj: patterns.graphlets(adj, 4)),
    "graphlet_sampled": on_cliques(lambda adj: patterns.sampled_graphlets(adj, convert.symmetric(adj).select("gid", F.col("u").alias("vid")))),
    "persistence_pairs": on_cliques(lambda adj: persistence.pairs(persistence.uniform_weights(adj))),
    "persistence_features": on_cliques(lambda adj: persistence.persistence_features(adj)[0]),
    "class_accuracies": lambda spark, sf_dir: learn.class_accuracies(knn_scored(spark, sf_dir)),
    "train_test_split": lambda spark, sf_dir: learn.train_test(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("gid")), 0.1, 2),
    "kfold_seeded": lambda spark, sf_dir: learn.kfold(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("gid")), 5, 2023),
    "silhouette": lambda spark, sf_dir: learn.silhouette_of(vectors(spark, sf_dir), labelled_clusters(spark, sf_dir)[1]),
    "davies_bouldin": lambda spark, sf_dir: learn.davies_bouldin(*labelled_clusters(spark, sf_dir)),
    "calinski_harabasz": lambda spark, sf_dir: learn.calinski_harabasz(*labelled_clusters(spark, sf_dir)),
    "event_sessions": sessions,
    "gen_dataset": lambda spark, _: generators.dataset(spark, 50),
    "gen_sweep": lambda spark, _: generators.sweep(spark, "edges", [10])[10],
    "kernel_hypergraph_motifs": motif_kernel,
    "kernel_hypergraph_mochy": motif_kernel,
    "kernel_graph_homo": named("graph_homo", "l_suppkey", 6),
    "kernel_graph_shortestpath": named("graph_shortestpath", "l_suppkey", 6),
    "kernel_hypergraph_sck": named("hypergraph_sck", places=6),
}
QUERIES |= {f"kernel_{name}": named(name) for name in KERNELS if f"kernel_{name}" not in QUERIES}
