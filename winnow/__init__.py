"""Data redundancy and active learning over Spark DataFrames.

``functions``  column expressions (cleaning, geometry, composition, losses)
``operators``  table to table operators (ranks, splits, scores, models, graphs)
``plans``      driver loops over operators (prune, grow, grids of runs)
``sources``    readers, writers and per-iteration run state
"""
