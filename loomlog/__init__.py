"""Analytics over ordered command logs and other line-oriented text, on Spark."""
