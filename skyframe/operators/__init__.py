"""Raster, segmentation, catalogue and dataset operators."""
