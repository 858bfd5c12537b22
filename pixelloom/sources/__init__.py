"""Reading and writing files of images."""

from .files import read_files, read_headers, stream_files, write_files

__all__ = ["read_files", "read_headers", "stream_files", "write_files"]
