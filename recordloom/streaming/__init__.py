"""Streams.

The data work of this package has no streaming operator: nothing in it keeps state. The
row-wise functions and plans (cleaning, repair, parsing, prompts, formatting with
quarantine, comparison with the built-in similarity) can be applied to a streaming
DataFrame as they are; `tests/test_streaming.py` runs formatting and comparison that way.
"""
