"""Facades that compose operators: collections, soundscapes, dataset splits."""
