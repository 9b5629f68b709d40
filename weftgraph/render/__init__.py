"""Renderers: text tables, JSON, DOT, SVG."""
