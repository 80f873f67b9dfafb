"""Relational operators: sorting, partitioning, sampling, de-duplication and frame structure."""
