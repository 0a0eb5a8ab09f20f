"""Operators of a training-data pipeline: quality, packing, secrets, privacy,
decontamination, near-duplicates, language, token files, sharding, toxicity.

Nothing outside this subpackage imports it.
"""
