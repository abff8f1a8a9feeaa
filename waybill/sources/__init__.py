"""Readers and writers: wire bodies, queues, result objects, tracking tables."""
