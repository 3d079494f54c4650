"""Part of the quern engine: operators."""
