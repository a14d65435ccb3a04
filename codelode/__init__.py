"""Source-code analytics on Spark: parse records, resolution, search, graph and change feeds as DataFrame plans."""
