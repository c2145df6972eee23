"""Table scans, fixtures and adapters of the supplied test tables."""
