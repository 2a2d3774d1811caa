"""Operators of a training-data pipeline over whole tables; nothing else in the library imports them."""
