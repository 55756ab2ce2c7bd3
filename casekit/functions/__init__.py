"""Column functions (labels, time, place); every one is a built-in expression."""
