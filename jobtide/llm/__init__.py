"""Training-data operators. Nothing else in jobtide imports this subpackage."""
