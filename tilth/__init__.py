"""A PySpark engine for field-sensor series, decisions on them, and plot-level rasters."""
