"""Part of the quern engine: streaming."""
