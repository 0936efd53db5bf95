"""Readers and writers: inventories, settlements, roads, units, rasters as tables, GeoJSON, manifests."""
