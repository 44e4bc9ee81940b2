"""Document-intelligence analytics on Spark: canonicalisation, quality rules, linking, search, scoring."""
