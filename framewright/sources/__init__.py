"""Files of time frames, the sidecar table, and generated data."""
