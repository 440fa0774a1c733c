"""Spark-native analytics over point clouds, voxels and the pipeline around them."""
