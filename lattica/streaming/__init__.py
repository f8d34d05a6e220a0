"""Streaming ingestion of facts."""
