"""Jobs built from the operators: the run (A1-A9), audit and published view (B4),
backfills and SQL (B1, B6), catalog tables, inputs derived from the test tables."""
