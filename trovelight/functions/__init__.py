"""Part of trovelight."""
