"""Sources and sinks: the labelled-post scan, dataset CSV/TSV files, line sets."""
