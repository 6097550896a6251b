"""Session, shared-scratch and iteration helpers."""
