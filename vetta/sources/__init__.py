"""Readers and writers: finding YAML, SARIF, run exports, CSV, reports."""
