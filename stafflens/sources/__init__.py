"""Inputs and outputs: declared schemas, the HR projection of the driver tables
(with its stored derived tables), CSV ingest and profile (W01, W03), table sink (W02)."""
