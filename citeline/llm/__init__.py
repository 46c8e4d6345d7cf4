"""Operators for preparing training text at corpus scale.

Nothing outside this subpackage imports it; ``queries.py`` registers the
``opN_<name>`` queries and ``corpus_pipeline.py`` at the repository top chains
five of the operators.
"""
