"""Version-controlled datasets as Spark tables: snapshots, diffs, merges, imports and remotes as DataFrame algebra."""

__version__ = "0.1.0"
