"""skyframe: raster and catalogue analytics expressed as Spark DataFrame jobs."""
