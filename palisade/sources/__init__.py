"""Readers and writers: tool output, feeds, event tables, snapshots."""
