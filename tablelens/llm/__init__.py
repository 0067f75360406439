"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame,
an id column and a text column, reads only those (other columns, whatever
their names, are ignored unless an operator says otherwise) and returns a new
DataFrame.
"""
