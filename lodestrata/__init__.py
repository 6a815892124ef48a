"""Spark-native prospectivity analytics: rasters as relations of cells."""
