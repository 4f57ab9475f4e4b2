"""Part of wickflow."""
