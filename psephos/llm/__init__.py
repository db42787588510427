"""Operators for preparing language-model training data.

One module per operator, each a plain function on DataFrames; ``queries``
holds the thin registered queries. Nothing else in the library imports this
subpackage.
"""
