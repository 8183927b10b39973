"""pagefuse: Spark-native processing of web text and ranked search results."""
