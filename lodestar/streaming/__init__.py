"""Streams and incremental work: limiter, new files, resumable embedding."""
