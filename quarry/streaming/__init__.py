"""Stateful operators, batch and Structured Streaming."""
