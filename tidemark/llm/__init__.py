"""Operations of a large-scale training-data pipeline, as Spark jobs.

Each module holds one operator with a general interface; ``queries`` registers
one query per operator over the driver's tables.
"""
