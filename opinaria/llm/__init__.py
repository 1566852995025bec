"""Operators of a training-data pipeline over the table ``documents``; nothing else imports them."""
