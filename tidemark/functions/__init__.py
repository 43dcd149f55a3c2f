"""Column functions with fixed semantics for nulls, ranks, frames and recursive averages."""
