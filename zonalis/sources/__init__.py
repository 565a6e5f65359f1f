"""Readers and writers of the file formats."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> None:
    """Make format("pmtiles") and format("geotiff") known, with filters pushed into them."""
    from .geotiff import GeoTIFFSource
    from .pmtiles import PMTilesSource

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (PMTilesSource, GeoTIFFSource):
        spark.dataSource.register(source)
