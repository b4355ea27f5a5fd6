"""Query registry: the named queries of the driver contract with their SQL."""
