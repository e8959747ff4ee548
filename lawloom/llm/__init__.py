"""Operators for preparing language-model training data: ten operators and the corpus pipeline made of five of them."""
