"""Streams of samples: queues, batches by count, staleness, and windows of event time."""
