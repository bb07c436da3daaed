"""Tables in, tables out: parquet inputs, JSONL corpora and the shared folder of intermediate tables."""
