"""Operations on training text: ten operators and the corpus pipeline. Nothing outside this package imports it."""
