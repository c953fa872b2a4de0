"""Content scoring and citation analytics over corpora, as Spark jobs."""
