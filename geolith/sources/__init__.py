"""Reading files as feature tables and writing them back.

``read_files`` goes through Spark's ``binaryFile`` source, so any file system that Spark knows will do; a file is one task, and files are
read in parallel. WKT and GeoParquet, which can be split, have readers of their own (``text``, ``geoparquet``). ``datasource`` offers the
same formats as ``spark.read.format("geo_...")``.
"""
