from pyspark.sql import functions as F

from kernelweave.operators import generators
from kernelweave.plans import experiment


def test_fern(spark):
    got = {}
    for r in generators.fern(spark, 2, 2).collect():
        got.setdefault(r.eid, set()).add(r.vid)
    assert got == {0: {0, 1, 8}, 1: {4, 5, 8}, 2: {2, 3, 9}, 3: {6, 7, 9}, 4: {8, 9}}


def test_linked_and_uniform(spark):
    a, b = generators.chain(spark, 3, 1, 1), generators.lattice(spark, 2)
    both = generators.linked(a, b, 7, 3, 0, 2)
    assert both.select("vid").distinct().count() == 7 + 4 - 1 and both.select("eid").distinct().count() == 3 + 4
    u = generators.uniform(spark, 3, 20, 6, 4)
    assert u.distinct().count() == u.count() == 3 * 6 * 4


def test_cross_validation(spark, tmp_path):
    inc = None
    for gid in range(10):
        own = generators.cycle(spark, 4 + gid // 2, 1, 1) if gid % 2 else generators.flower(spark, 4 + gid // 2, 1, 1)
        own = own.select(F.lit(gid).cast("long").alias("gid"), "eid", "vid")
        inc = own if inc is None else inc.unionByName(own)
    inc = spark.createDataFrame(inc.coalesce(1).collect(), inc.schema)
    labels = spark.createDataFrame([(g, "ring" if g % 2 else "petal") for g in range(10)], "gid long, y string")
    results = experiment.run(inc, labels, experiment.Settings(kernels=("hypergraph_v_e",), folds=2))
    assert [r.accuracy for r in results.collect()] == [1.0, 1.0]
    experiment.write_csv(experiment.summary(results), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).first().f1_macro_mean == "1.0"
