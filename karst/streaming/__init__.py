"""Streams: an extension over the batch operators."""
