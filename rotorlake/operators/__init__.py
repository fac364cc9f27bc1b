"""Jobs over clip, frame, feature, score and label tables; DataFrames in, DataFrames out."""
