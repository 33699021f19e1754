"""Tile pyramids as relations: operators, sources, functions, plans and streams on Spark DataFrames."""
