"""Nothing here yet: the engine's data model has no streams, watermarks or state.

Document folders can be followed with ``spark.readStream.format("binaryFile")``;
all operators that work on one document at a time apply to such a stream as
they are.
"""
