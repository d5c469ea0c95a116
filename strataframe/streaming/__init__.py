"""Streams into repositories."""
