"""Part of the quern engine: plans."""
