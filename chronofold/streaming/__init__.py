"""The same folds on streams."""
