"""Operators of a training-data pipeline over documents and pages.

Each operator takes and returns DataFrames, selects the columns it needs by name
(further columns, whatever their names, are left alone) and keeps nothing that
grows with the corpus on the driver or in one task.
"""
