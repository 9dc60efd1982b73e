"""Operators of a training-data pipeline over tables of documents; nothing outside this folder imports it."""
