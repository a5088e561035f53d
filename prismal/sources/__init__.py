"""Readers of signal, stick, peak-list, label and job-output files."""
