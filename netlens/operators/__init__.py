"""Operators over events, flows and frames."""
