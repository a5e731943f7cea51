"""Preparing training text for language models: ten operators over document tables."""
