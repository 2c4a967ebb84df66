"""End-to-end jobs composed of operators: build databases, compute, compare."""
