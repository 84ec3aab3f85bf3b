"""Operations on frames and series."""
