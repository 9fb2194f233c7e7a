"""Ready-made queries and jobs built from the operators."""
