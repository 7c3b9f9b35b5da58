"""File formats and data sources: segment files, Avro."""
