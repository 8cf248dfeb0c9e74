"""Incremental operators over streams. Beyond the batch library's scope, kept small."""
