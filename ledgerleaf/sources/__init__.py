"""Readers: directories, naive CSV, profiles and PDF forms."""
