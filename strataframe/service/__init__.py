"""Repositories served over HTTP, for remotes whose storage is not shared."""
