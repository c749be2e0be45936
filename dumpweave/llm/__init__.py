"""Operators of a training-data pipeline over tables of documents and pages.

One module per operator; ``queries`` registers them over the driver's tables.
Nothing else in the library imports this package.
"""
