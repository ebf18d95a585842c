"""Operators for preparing training data, one module per operator.

Nothing else in the package imports this subpackage.  ``queries`` holds the
``opN_*`` queries over the synthetic tables and their SQL.
"""
