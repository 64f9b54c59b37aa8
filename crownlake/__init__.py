"""Crownlake: Spark-native crown, raster and table analytics."""
