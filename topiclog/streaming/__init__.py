"""The log's state machine as a stream."""
