"""Operators for preparing training corpora: thirteen methods and the queries that apply them."""
