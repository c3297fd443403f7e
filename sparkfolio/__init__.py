"""Document analytics on Spark: detection, parsing into a relational document model, extraction and rendering."""
