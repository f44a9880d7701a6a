"""Raster-as-table analytics on Spark: a pixel is a row, a band a column, a step a DataFrame operation."""
