"""Live task state and logs."""
