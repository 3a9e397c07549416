"""Plan building blocks shared by operators: lineage cuts, skew handling."""
