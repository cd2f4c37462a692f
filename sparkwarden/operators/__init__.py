"""Row-wise operators on messages."""
