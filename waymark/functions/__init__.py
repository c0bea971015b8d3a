"""Column-level building blocks: geodesy, geometry arrays, WKB, row shaping."""
