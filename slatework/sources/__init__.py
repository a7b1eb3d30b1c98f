"""Tables in and results out: Parquet folders, delimited text, block files, SQLite, text lines."""
