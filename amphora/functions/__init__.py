"""Part of the amphora engine."""
