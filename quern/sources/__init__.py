"""Part of the quern engine: sources."""
