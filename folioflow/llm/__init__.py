"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  Operators live one to a
module; ``queries`` registers one thin query per operator and their SQL.
"""
