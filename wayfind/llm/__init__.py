"""Operations on training data: one module for each, with their queries in ``queries``."""
