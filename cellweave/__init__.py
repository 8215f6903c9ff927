"""cellweave: table-entity alignment and corpus preparation as Spark jobs."""
