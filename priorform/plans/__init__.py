"""Multi-stage plans built from the operators."""
