"""Storage: small files by Hadoop's FileSystem, tables as Parquet, and readers of outside data."""
