"""Running frozen anomaly detectors over per-entity streams and measuring what they cost to operate."""
