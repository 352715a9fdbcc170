"""Inputs and outputs: logical table schemas, readers (Parquet, JDBC), test bindings, sinks."""
