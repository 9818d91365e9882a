"""Population-health measures as PySpark DataFrame operators.

Sub-packages
------------
functions   Column -> Column building blocks (codes, text, bands, statistics)
operators   DataFrame -> DataFrame operators (episodes, reshape, breakdowns, rates, ...)
plans       study-level plans composed from the operators
sources     table schemas, readers and writers, fixed value lists, test-data bindings
"""
