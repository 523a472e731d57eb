"""Operators for preparing large text corpora for language-model training.

Nothing else in the library imports this subpackage. Every operator takes DataFrames and
returns DataFrames; ``queries`` holds the registered ``opN_*`` queries over the given tables.
"""
