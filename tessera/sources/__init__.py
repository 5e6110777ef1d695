"""Reading labels, rasters, catalogs and metrics; writing splits, patches and metrics."""
