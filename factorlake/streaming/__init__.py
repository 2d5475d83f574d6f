"""Tick streams landed in keyed tables with Structured Streaming."""
