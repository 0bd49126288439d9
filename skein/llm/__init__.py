"""Operators for preparing training data.  Nothing else in skein imports this."""
