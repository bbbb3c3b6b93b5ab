"""Sources and sinks: book files, driver tables."""
