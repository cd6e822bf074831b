"""Operators that prepare training text: deduplication, language, quality, tokens, mixing. Nothing else imports them."""
