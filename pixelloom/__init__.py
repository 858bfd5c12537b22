"""pixelloom: raster images and image metadata as Spark relations."""

__version__ = "0.1.0"
