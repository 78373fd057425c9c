"""Operations of a training-data pipeline over document corpora.

Each module holds one operator with its own general interface; ``queries``
holds the thin queries that derive the contracted digest columns from them.
Nothing else in the library imports this subpackage.
"""
