"""Training-data operators: fingerprints, near-duplicates, classifiers,
extraction, packing, formatting and mixing.  Nothing outside this subpackage
imports it."""
