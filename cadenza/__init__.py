"""A Spark-native engine for music catalogs: search, ranking, sequencing and playlists."""
