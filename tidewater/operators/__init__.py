"""DataFrame operators: projection and filters (A2, A3, A5, A6), counts (A4, A9),
mirror (B3)."""
