"""Training-data operators: ANN, quality, dedup, decontamination, mixing, token counts and more.

Nothing outside this subpackage imports it.
"""
