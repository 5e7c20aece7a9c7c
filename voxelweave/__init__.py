"""Particle and mesh analytics on Spark: spatial binning, exact nearest neighbours, Voronoi meshes, finite volumes."""
