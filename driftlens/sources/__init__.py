"""Scans and sinks: driver tables, landed pages, id lists, CSV, unions."""
