"""Reusable DataFrame operators: latest-per-key, ordered neighbours,
as-of join, bounded broadcast, pages and top-k."""
