"""Query plans: the extraction pipeline and the registered queries."""
