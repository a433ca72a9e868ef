"""corpusloom: DataFrame-native preparation and measurement of text corpora."""
