"""Scalar functions as Spark Columns: special functions, densities, transforms, biology."""
