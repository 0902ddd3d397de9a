"""Deliberately empty: the feature set has no streaming source, window or state.

All operators are batch transforms over stored tables (see README, "Scope").
"""
