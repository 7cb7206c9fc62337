"""Readers: point files as Python data sources, containers, manifests."""
