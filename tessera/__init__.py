"""Tessera: raster, byte-block and text analytics as Spark DataFrame plans."""
