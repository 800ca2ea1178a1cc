"""Column helpers: text tests, repeatable hashing, label vocabulary."""
