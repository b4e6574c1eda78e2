"""Column-level helpers and the shared-storage helper."""
