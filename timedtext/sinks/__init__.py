"""Sinks: JSON, HTML, slide and layout tables."""
