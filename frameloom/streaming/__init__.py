"""Graphs and stateful operators over Structured Streaming."""
