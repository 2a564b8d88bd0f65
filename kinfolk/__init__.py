"""Entity grouping on Spark: detections in, ranked groups and a run report out."""
