"""Incremental forms: resumable scoring, paced batches, and windows over events."""
