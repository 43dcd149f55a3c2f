"""Sources and sinks: adapters from stored tables to panel tables."""
