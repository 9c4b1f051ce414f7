"""Column functions: text cleaning, analysis, vectors and encoders."""
