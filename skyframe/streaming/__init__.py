"""Row-wise operators over streams."""
