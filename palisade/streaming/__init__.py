"""Structured Streaming: time-to-live and once-only deduplication, last-state diffs, tumbling buckets, event routing.

Keyed state lives in Spark's state store, so a micro-batch touches only the keys that it meets; tables that grow with the keys are laid out in buckets and change
together with the events of a batch (``sources.commits``).  Outputs are written under the batch number and replaced or left when a batch is retried.
"""
