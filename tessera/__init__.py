"""tessera: analytics over labelled before/after raster tiles, as Spark DataFrame operators."""

__version__ = "0.1.0"
