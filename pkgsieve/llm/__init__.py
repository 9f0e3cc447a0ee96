"""Operators of a training-data pipeline, one module each.

``queries`` registers one query per operator in ``QUERIES`` / ``ORACLES``.
Nothing outside this package imports it.
"""
