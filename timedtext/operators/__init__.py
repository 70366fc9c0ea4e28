"""Relational operators over cues, frames and pages."""
