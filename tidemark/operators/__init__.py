"""Operators: DataFrame(s) and parameters in, lazy DataFrame out. No actions, no sessions, no forced broadcasts."""
