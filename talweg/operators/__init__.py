"""Operators on DataFrames: stencils, hydrology, stability, ranking, validation, fitting, reach, lines, units."""
