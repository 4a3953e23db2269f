"""Readers and writers of measurements, drivers, predictions and results."""
