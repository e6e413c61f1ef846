"""grainmill.operators."""
