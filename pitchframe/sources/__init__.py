"""Readers, shared-table materialisation and the test-data mapping."""
