"""Manifests, their validation and their runs."""
