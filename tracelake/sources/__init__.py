"""Sources and sinks of traces, manifests and reports."""
