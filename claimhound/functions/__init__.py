"""Column builders and grouping helpers shared by the analyses."""
