"""Writers: CSV lines in order, profiles and filled PDF forms."""
