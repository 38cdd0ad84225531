"""Operations of a training-data pipeline: cleaning, scoring, deduplication, tokenisation and sharding of text tables.

Each module holds one operator with a general interface; ``queries`` registers one thin query per operator.
"""
