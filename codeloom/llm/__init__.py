"""Training-data operators. Nothing else in codeloom imports this subpackage."""
