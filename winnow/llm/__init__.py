"""Training-data operators: language, quality, duplicates, licences, contamination, packing.

Every operator takes DataFrames and column names and returns a DataFrame. Inputs are narrowed
to the named columns at once, so further columns, whatever their names, never matter.
"""
