"""Hidden geometry of complex networks, planned by Spark."""
