"""graphloom: Spark-native analytics over symbol graphs, event logs and transcripts.

Every operator is a plain function from DataFrame to DataFrame.
"""
