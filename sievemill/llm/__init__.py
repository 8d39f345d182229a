"""Operators of a training-data pipeline: quality, dedup, decontamination, chat formatting, mixing."""
