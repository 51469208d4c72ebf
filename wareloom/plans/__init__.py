"""Multi-step jobs and the query catalogue bound to the supplied tables."""
