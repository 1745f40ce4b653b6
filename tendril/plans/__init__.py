"""Composite operators: analytic views, functions, temporal, rules, changes, quality."""
