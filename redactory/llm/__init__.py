"""Training-data operators: sharding, classifiers, dedup, tokenisation, scoring, runs, mining.

Nothing outside this package imports it; ``queries.py`` registers its queries.
"""
