"""Empty: the survey has no streaming operator, and asks that none be built for parity."""
