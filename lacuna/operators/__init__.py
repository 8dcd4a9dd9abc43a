"""Operators over DataFrames. The canonical long form of a series is (episode_id, seq, t, var, v), v NULL where missing."""
