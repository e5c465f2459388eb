"""Graphs: reading, checking, binding values, and compiling to a DataFrame."""
