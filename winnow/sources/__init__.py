"""Readers and writers of records, result sets, logs, reports and file manifests."""
