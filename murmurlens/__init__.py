"""Comment moderation analytics on Spark DataFrames."""

from murmurlens.config import LABELS, LEVELS, TOXIC_LABELS, VIETNAMESE, TextConfig

__all__ = ["LABELS", "LEVELS", "TOXIC_LABELS", "VIETNAMESE", "TextConfig"]
