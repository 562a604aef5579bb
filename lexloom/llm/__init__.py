"""Operators of a training-data pipeline over a `documents` table.

One module per operator; `queries` holds the registered queries and their SQL.
Nothing else in the package imports this subpackage.
"""
