"""Operators for preparing training corpora at scale.

Ten operators, one module each, plus ``queries`` (the registered queries and
their SQL). Nothing outside this package imports it.
"""
