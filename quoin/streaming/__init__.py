"""Streams of manifest files: the batch operators over files as they arrive."""
