"""Web-query workloads as Spark jobs: resolve queries, read pages, answer, store, report."""
