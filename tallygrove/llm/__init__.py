"""Operations for large training-data corpora."""
