"""Deferred tasks, events, blocks and error propagation."""
