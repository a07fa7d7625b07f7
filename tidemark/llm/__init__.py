"""Operations of a training-data pipeline over tables of texts.

Nothing else in the library imports this subpackage.
"""
