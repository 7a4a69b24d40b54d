"""quire: paginated documents as relations, on Spark."""
