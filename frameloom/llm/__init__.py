"""Operators for preparing language-model training data at corpus scale.

Nothing outside this subpackage imports it; ``corpus_pipeline.py`` at the top
of the repository chains five of its operators.
"""
