"""Sources and sinks: saved API listings, the raw store, question sets, reports."""
