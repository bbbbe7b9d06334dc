"""Training-data operators: PII, scoring, sharding, packing, similarity search and quality.

Nothing outside this subpackage imports it; the entry module adds its queries
when it is present.
"""
