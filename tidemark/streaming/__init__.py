"""Nothing is built here: the data operators this library covers work on finished tables, and none keeps a stream's
state. Row-wise operators (parsing, recoding, masking, tokens) are stateless and run unchanged on streaming frames.
"""
