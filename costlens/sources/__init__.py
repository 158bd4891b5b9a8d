"""Readers and writers: billing exports, thresholds, forecasts, and test fixtures."""
