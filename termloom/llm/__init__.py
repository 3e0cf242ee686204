"""Operators for preparing text corpora for language-model training.

Nothing outside this subpackage imports it.  Modules whose names start with
``op_`` each hold one operator; ``queries`` registers them over the tables.
"""
