"""Ready-made jobs: a registry and parameters in, a report out."""
