"""Re-scans as a stream."""
