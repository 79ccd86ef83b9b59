"""Operators from DataFrame to DataFrame. All are lazy but those named check_ or described as looking at the data."""
