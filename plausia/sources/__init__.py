"""Scans of thread, extraction and label files, and sinks."""
