"""Spark-native analytics: spatial feature association, rankings, graphs, rasters and linear models."""
