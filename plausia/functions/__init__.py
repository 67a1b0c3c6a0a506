"""Text functions, as Columns where the built-in functions can say it and as Arrow-batched UDFs where they can't."""
