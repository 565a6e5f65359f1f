"""Zonal analytics over gridded earth-observation data as relations of pixels, on Spark."""
