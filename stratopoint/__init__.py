"""stratopoint: point clouds, cameras and height grids as Spark DataFrames."""

__version__ = "0.1.0"
