"""Streaming forms of the operators whose state evolves with the log.

Within a micro-batch rows are taken in the order of their sequence or time; a row that arrives in a
later micro-batch than its successor is judged against the state that the successor left.
"""
