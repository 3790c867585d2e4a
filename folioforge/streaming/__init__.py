"""Structured Streaming forms of the keyed state machines: utterances, folded deltas, accumulated blocks, live catalogs."""
