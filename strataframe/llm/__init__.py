"""Operators for large-scale training-data pipelines.

One module per operator; ``queries`` registers one production query for each.
Nothing else in the package imports this subpackage.
"""
