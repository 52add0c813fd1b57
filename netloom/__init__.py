"""netloom: Spark jobs over long cell-by-gene tables and gene networks."""
