"""Sources and sinks of the points model."""
