"""Training-data operators: quality, licences, scoring, PII, tokenisation and dedup.

Nothing else in ``quire`` imports this subpackage; it can be removed whole.
"""
