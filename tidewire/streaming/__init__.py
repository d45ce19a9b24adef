"""Structured Streaming: the detector by symbol, the follower, and sinks."""
