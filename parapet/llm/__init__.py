"""Operators for preparing the text a language model is trained on."""
