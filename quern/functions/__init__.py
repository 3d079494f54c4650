"""Part of the quern engine: functions."""
