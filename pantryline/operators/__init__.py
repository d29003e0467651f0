"""Reusable DataFrame operators: de-duplication, group splitting, integrity, paging, text containment."""
