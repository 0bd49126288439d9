"""skein: DataFrame operators that turn many overlapping records into few."""
