"""Operators for preparing text and vectors for language-model training. Nothing else imports them."""
