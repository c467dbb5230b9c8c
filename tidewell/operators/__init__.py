"""Composite operators: whitelist, assignment, molecules, abundances, matrix."""
