"""Readers and writers: event topics, product files, vector index, profile snapshots."""
