"""Training-data operators: decontamination, packing, extraction, fingerprints, archives, scans, filters, dedup.

Nothing outside this subpackage imports it. Every operator takes and returns DataFrames; see ``queries`` for the
registered production runs.
"""
