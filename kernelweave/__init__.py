"""Graph and hypergraph similarity kernels as Spark DataFrame plans."""
