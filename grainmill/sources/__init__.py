"""grainmill.sources."""
