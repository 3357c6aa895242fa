"""Training-data operators. Nothing else in trovelight imports this subpackage."""
