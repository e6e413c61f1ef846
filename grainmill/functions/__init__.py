"""grainmill.functions."""
