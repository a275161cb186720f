"""Operations of a training-data pipeline on tables of documents and pages.

Nothing else in the library imports this subpackage.
"""
